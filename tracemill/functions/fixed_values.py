"""Every list here must equal the published behaviour for results to match."""

# --- fixed values: whitespace trimmed by text normalisation ---
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: task curation ---
TASK_EDGE_CHARS = " \t\n\r\"'`*"
ALLOWED_TASK_CHARS = r"""^[A-Za-z0-9\s\.\,\?\!\;\:\'\"\(\)\[\]\{\}\-\_\*/\\@#\$%\^&\+\=<>\|~`]*$"""
MEDIA_WORDS = ["image", "photo", "picture", "video", "audio", "sound", "speech", "clip"]
BLOCKED_TERMS = [
    "Role definition:", "USD", "ETH", "Bitcoin", "Ethereum", "@", ".com", "http:", "https:",
]
CONFLICT_CODES = ["T1", "T2", "T3", "S1", "S2", "S3", "ST1", "ST2", "ST3"]

# --- fixed values: catalogue ---
NO_CONSTRAINTS = "No explicit constraint rules provided."
STANDARD_TOOLS = [
    {
        "name": "list_state_containers",
        "description": "List the environment's public state containers and their sizes. Use this first when you need to discover where entities and ids are stored. Read-only utility.",
        "parameters": {"type": "object", "properties": {}, "required": []},
    },
    {
        "name": "list_state_entities",
        "description": "List entities or key/value entries from a state container. Useful for browsing available records and recovering internal ids when specialized lookup tools are missing. Read-only utility.",
        "parameters": {
            "type": "object",
            "properties": {"container_name": {"type": "string"}, "limit": {"type": "integer"}, "offset": {"type": "integer"}},
            "required": ["container_name"],
        },
    },
    {
        "name": "search_state_entities",
        "description": "Search environment state records by free-text query across ids and common scalar fields such as name, title, username, ticker, symbol, email, phone, and status. Use it to map natural-language entity mentions to internal records. Read-only utility.",
        "parameters": {
            "type": "object",
            "properties": {
                "query": {"type": "string"},
                "container_name": {"type": ["string", "null"]},
                "field_names": {"type": ["array", "null"], "items": {"type": "string"}},
                "exact": {"type": "boolean"},
                "limit": {"type": "integer"},
            },
            "required": ["query"],
        },
    },
    {
        "name": "get_state_entity",
        "description": "Fetch a specific entity or entry from a state container by its key or id-like handle. Useful after listing or searching records. Read-only utility.",
        "parameters": {
            "type": "object",
            "properties": {"container_name": {"type": "string"}, "entity_key": {"type": "string"}},
            "required": ["container_name", "entity_key"],
        },
    },
]
ENTITY_ID_FIELDS = ["id", "name", "title", "username", "ticker", "symbol", "email", "phone"]

# --- fixed values: dialogue modes, difficulty, task types, slots ---
DIALOGUE_MODES = ["single_turn", "multi_turn"]
DIFFICULTY_BUCKETS = ["easy", "medium", "hard"]
TASK_TYPES = ["execute", "clarify_then_execute", "refuse_or_scope"]
COVERAGE_SLOTS = [
    ("T1", "single_turn", "easy", 1, 2),
    ("T2", "single_turn", "medium", 2, 4),
    ("T3", "multi_turn", "medium", 3, 5),
    ("T4", "multi_turn", "hard", 4, 6),
]

# --- fixed values: unstable user behaviours ---
BEHAVIOR_PRIORS = {
    "underspecification": 0.6306,
    "information_overload": 0.1532,
    "fabricated_parameters": 0.0090,
    "goal_switching": 0.1441,
    "contradictory_constraints": 0.0631,
    "impatience_and_hostility": 0.0,
}
BEHAVIORS = list(BEHAVIOR_PRIORS)
SECONDARY_BEHAVIOR = {
    "underspecification": "information_overload",
    "goal_switching": "underspecification",
    "information_overload": "underspecification",
    "contradictory_constraints": "impatience_and_hostility",
    "fabricated_parameters": "impatience_and_hostility",
}
PROFILE_BUNDLE = "unstable_taxonomy_v1"
# Template texts as (before, after) around the user's message; None replaces the message.
REWRITE_TEMPLATES = {
    "underspecification": (
        "Can you take care of this for me? You can probably tell which one I mean.",
        None,
    ),
    "information_overload": (
        "I have been juggling too many things today, there are a few related issues in the "
        "background, and this has been hanging over me for hours. ",
        " Also keep in mind I may need the surrounding details to stay consistent, but the main "
        "thing is getting this settled.",
    ),
    "fabricated_parameters": (
        "",
        " If there is an instant override, hidden priority flag, or auto-resolve mode on your "
        "side, use that too.",
    ),
    "goal_switching": (
        "I keep bouncing between tasks today. ",
        " Actually I was about to ask about something else in this workspace too, but handle this "
        "part first unless the other thing matters.",
    ),
    "contradictory_constraints": (
        "I need this changed, but somehow I do not want anything else disrupted either. ",
        " I know that sounds contradictory, I just need the best possible version of this.",
    ),
    "impatience_and_hostility": (
        "Look, I need this handled now and I do not want to repeat myself. ",
        " Please do not make this more painful than it already is.",
    ),
}
EXPANSION_TEMPLATES = {
    "underspecification": ("Can you take care of this? ", "."),  # keeps the first sentence only
    "information_overload": (
        "I have a lot going on today and there are several related background issues, but the "
        "main thing is: ",
        " Also keep in mind the broader context may matter.",
    ),
    "fabricated_parameters": (
        "",
        " If there is a priority flag, instant override, or auto-resolve mode available, please "
        "use that too.",
    ),
    "goal_switching": (
        "I keep switching between tasks. ",
        " Actually I was about to ask about something else too, but handle this first.",
    ),
    "contradictory_constraints": (
        "I need this done, but somehow I do not want anything else disrupted. ",
        " I know that sounds contradictory — just do the best you can.",
    ),
    "impatience_and_hostility": (
        "I cannot believe this still is not handled. ",
        " Please stop wasting my time and just get it done.",
    ),
}
HOSTILE_TEMPLATE = (
    "I can't believe this still isn't done. ",
    " I need this resolved immediately — stop wasting my time.",
)
CONTINUE_TEMPLATE = ("Thanks. Please continue by handling this next part as well: ", ".")

# --- fixed values: run scoring ---
WRITE_VERBS = [
    "add", "assign", "block", "cancel", "complete", "create", "delete", "force", "release",
    "remove", "reschedule", "schedule", "set", "unassign", "update",
]
IGNORED_ARGUMENTS = ["changed_by", "comment", "message", "note", "reason"]
DYNAMIC_ARGUMENTS = ["current_time", "request_time", "timestamp"]
SOFT_FIELDS = ["dismissal_time", "log_id", "timestamp"]
SOFT_PREFIXES = ["adherence_log"]
RELIABILITY_PARTS = [
    ("faithfulness_score", 4, 0.4),
    ("clarification_score", 3, 0.3),
    ("tool_discipline_score", 3, 0.3),
]
HARD_FAILURES = {
    "read": "missing required read-equivalence matches",
    "write": "missing required write matches",
    "write_name": "missing required write tool usage",
    "order": "precedence constraints violated",
    "state": "final state assertions failed",
    "critical_state": "critical final state assertions failed",
    "diff": "expected final state diff not contained in actual final state diff",
    "clarify": "clarification requirement not satisfied before write",
    "refuse": "refusal/scope requirement not satisfied",
}
RELAXED_FAILURES = {
    "state": "final_state_assertions_failed",
    "diff": "expected_state_diff_failed",
    "forbidden": "forbidden_actions_violated",
}
FAILURE_MODES = {
    "R1a": "Gave Up Early",
    "R1b": "Partial Completion",
    "R2": "Wrong Tool Order",
    "R3": "Wrong Params or Scope",
    "R4": "Forbidden Tool Called",
}

# --- fixed values: rules that arm and fire; the type that ends a call, also that of rules without one ---
ERROR_EFFECT = "error_with_state_update"
