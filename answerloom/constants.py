"""Fixed values of the question format.

Everything in this file is a fixed value: names, word lists, prompts, quotas and
patterns that have to be the same in every tool that reads or writes a bank.
"""

# --- fixed values: question types -----------------------------------------
QUESTION_TYPES = (
    "primary_action",
    "aggressor_identification",
    "victim_recognition",
    "bystander_detection",
    "perspective_aggressor",
    "scene_location",
    "interaction_summary",
    "social_appropriateness",
    "role_count_aggressor",
    "role_count_victim",
    "role_count_bystander",
    "compound_aggressor_location",
    "compound_action_victims",
    "compound_action_aggressor",
    "compound_action_location",
    "compound_aggressor_victim",
    "compound_bystander_location",
    "compound_aggressor_victim_count",
    "compound_victim_bystander_count",
    "compound_aggressor_action_victim",
    "role_identification",
    "sequence_verification",
)

# --- fixed values: category of a type, and questions per clip and category --
TYPE_CATEGORY = {
    "aggressor_identification": "simple",
    "victim_recognition": "simple",
    "bystander_detection": "simple",
    "primary_action": "simple",
    "compound_action_victims": "compound",
    "compound_action_aggressor": "compound",
    "compound_action_location": "compound",
    "compound_aggressor_victim": "compound",
    "compound_bystander_location": "compound",
    "compound_aggressor_action_victim": "complex",
    "sequence_verification": "complex",
    "role_count_aggressor": "counting",
    "role_count_victim": "counting",
    "role_count_bystander": "counting",
    "compound_aggressor_victim_count": "counting",
    "compound_victim_bystander_count": "counting",
    "role_identification": "identification",
}
CATEGORY_QUOTA = {"simple": 2, "compound": 4, "complex": 1, "counting": 1, "identification": 1}
EVEN_CLIPS_ONLY = "compound_aggressor_victim"

SECONDARY_TYPES = (
    "compound_action_location",
    "role_count_aggressor",
    "role_count_victim",
    "role_count_bystander",
    "compound_aggressor_victim_count",
    "compound_victim_bystander_count",
)
PRIMARY_LEADERBOARD_TYPES = (
    "primary_action",
    "role_identification",
    "aggressor_identification",
    "victim_recognition",
    "compound_action_aggressor",
    "compound_action_victims",
    "compound_aggressor_victim",
    "compound_aggressor_action_victim",
    "sequence_verification",
)

# --- fixed values: three tier maps, which disagree on purpose ---------------
TIER_MAPS = {
    "simple_compound_fine": {
        "primary_action": "simple",
        "role_identification": "simple",
        "aggressor_identification": "simple",
        "victim_recognition": "simple",
        "compound_action_victims": "compound",
        "compound_aggressor_victim": "compound",
        "compound_aggressor_action_victim": "fine_detail",
        "sequence_verification": "fine_detail",
    },
    "basic_compound_detailed": {
        "primary_action": "Basic",
        "aggressor_identification": "Basic",
        "victim_recognition": "Basic",
        "role_identification": "Basic",
        "compound_action_aggressor": "Compound",
        "compound_action_victims": "Compound",
        "compound_aggressor_victim": "Compound",
        "compound_aggressor_action_victim": "Detailed",
        "sequence_verification": "Detailed",
    },
    "heatmap": {
        "primary_action": "Basic",
        "aggressor_identification": "Basic",
        "victim_recognition": "Basic",
        "role_identification": "Basic",
        "compound_action_aggressor": "Compound",
        "compound_action_victims": "Compound",
        "compound_aggressor_victim": "Compound",
        "compound_aggressor_action_victim": "Compound",
        "sequence_verification": "Detailed",
        "compound_action_location": "Secondary",
        "compound_aggressor_victim_count": "Secondary",
        "role_count_aggressor": "Secondary",
        "role_count_victim": "Secondary",
        "role_count_bystander": "Secondary",
    },
}

# --- fixed values: capability groups (a type may be in more than one) -------
CAPABILITY_GROUPS = {
    "Action Only": ("primary_action",),
    "Role Only": ("aggressor_identification", "victim_recognition"),
    "Action + Role (compound)": (
        "compound_aggressor_action_victim",
        "compound_action_victims",
        "sequence_verification",
    ),
    "Role Pairing": ("compound_aggressor_victim",),
    "Role ID (label)": ("role_identification",),
}

# --- fixed values: distractor labels, hardest first --------------------------
HARDNESS_PRIORITY = {
    "role_reversal": 0,
    "wrong_action": 1,
    "wrong_victim": 2,
    "wrong_aggressor": 3,
    "bystander_substitution": 4,
    "wrong_location": 5,
    "wrong_category": 6,
    "none_claim": 7,
    "other_in_cast": 8,
    "cross_video": 9,
    "frequency_saturation": 10,
}
UNKNOWN_PRIORITY = 99
REPORTED_LABELS = (
    "role_reversal",
    "cross_video",
    "wrong_action",
    "wrong_aggressor",
    "wrong_victim",
    "wrong_category",
    "wrong_location",
    "bystander_substitution",
    "frequency_saturation",
    "none_claim",
)
FALLBACK_ORDER = (
    "role_reversal",
    "wrong_action",
    "wrong_victim",
    "wrong_aggressor",
    "bystander_substitution",
    "wrong_location",
    "wrong_category",
    "cross_video",
)

# --- fixed values: how many distractors of each label a type asks for --------
DEFAULT_RECIPES = {
    "aggressor_identification": {"role_reversal": 1, "bystander_substitution": 2, "cross_video": 4},
    "victim_recognition": {"role_reversal": 1, "bystander_substitution": 2, "cross_video": 4},
    "perspective_aggressor": {"role_reversal": 1, "bystander_substitution": 2, "cross_video": 4},
    "bystander_detection": {"wrong_aggressor": 2, "wrong_victim": 2, "cross_video": 3},
    "primary_action": {"wrong_category": 7},
    "social_appropriateness": {"wrong_category": 7},
    "scene_location": {"wrong_category": 7},
    "compound_aggressor_action_victim": {
        "role_reversal": 1, "wrong_action": 1, "wrong_victim": 1,
        "wrong_aggressor": 1, "bystander_substitution": 1, "cross_video": 2,
    },
    "interaction_summary": {
        "role_reversal": 1, "wrong_action": 1, "wrong_victim": 1,
        "wrong_aggressor": 1, "bystander_substitution": 1, "cross_video": 2,
    },
    "sequence_verification": {
        "role_reversal": 1, "wrong_action": 1, "wrong_victim": 1,
        "wrong_aggressor": 1, "bystander_substitution": 1, "cross_video": 2,
    },
    "compound_action_victims": {
        "role_reversal": 1, "wrong_action": 2, "wrong_victim": 2,
        "bystander_substitution": 1, "cross_video": 1,
    },
    "compound_action_aggressor": {
        "role_reversal": 1, "wrong_action": 2, "wrong_aggressor": 2,
        "bystander_substitution": 1, "cross_video": 1,
    },
    "compound_aggressor_victim": {
        "role_reversal": 1, "wrong_victim": 2, "wrong_aggressor": 2,
        "bystander_substitution": 1, "cross_video": 1,
    },
    "compound_action_location": {"wrong_action": 3, "wrong_location": 3, "cross_video": 1},
    "compound_aggressor_location": {
        "role_reversal": 1, "wrong_aggressor": 2, "bystander_substitution": 1,
        "wrong_location": 2, "cross_video": 1,
    },
    "compound_bystander_location": {"bystander_substitution": 2, "wrong_location": 3, "cross_video": 2},
    "role_identification": {"role_reversal": 1, "bystander_substitution": 1, "none_claim": 1},
}
INVERTED_TYPES = ("compound_aggressor_action_victim", "interaction_summary", "sequence_verification")

# Fixed layout of a frequency-inverted question: (label, aggressor, victim, action);
# A and B are the clip's aggressor and victim, gt its action, d1 and d2 two others.
INVERTED_LAYOUT = (
    ("role_reversal", "B", "A", "gt"),
    ("correct", "A", "B", "gt"),
    ("frequency_saturation", "A", "B", "d1"),
    ("frequency_saturation", "B", "A", "d1"),
    ("frequency_saturation", "A", "A", "d1"),
    ("frequency_saturation", "A", "B", "d2"),
    ("frequency_saturation", "B", "A", "d2"),
    ("frequency_saturation", "B", "B", "d2"),
)

# --- fixed values: prompts, null answers and required fields -----------------
PROMPTS = {
    "primary_action": "If there is an aggressive action taking place in this video, describe it as one of the following:",
    "aggressor_identification": "Who in the video is performing the aggressive behavior?",
    "victim_recognition": "Which person appears to be the target or victim of the aggression shown?",
    "bystander_detection": "Who is present during the incident but does not directly participate?",
    "perspective_aggressor": "If you were observing this scene, which person would you describe as the aggressor?",
    "scene_location": "What location or setting is the video taking place in?",
    "interaction_summary": "Which summary most accurately describes the interactions between the people in the video?",
    "social_appropriateness": "Which action in the video would most likely be considered socially inappropriate or aggressive?",
    "role_count_aggressor": "How many aggressive people are in the video?",
    "role_count_victim": "How many victims are in the video?",
    "role_count_bystander": "How many bystanders are in the video?",
    "compound_aggressor_location": "What is the aggressor wearing and what location is the event taking place?",
    "compound_action_victims": "Describe the action taking place in the video and describe any victims that are present",
    "compound_action_aggressor": "Describe the action taking place in the video and identify the aggressor",
    "compound_action_location": "Which of the following most accurately describes both the specific type of aggressive action and the location where it occurs?",
    "compound_aggressor_victim": "Which of the following correctly identifies the roles of the individuals shown?",
    "compound_bystander_location": "Who is present but not participating, and where is this taking place?",
    "compound_aggressor_victim_count": "How many aggressors and how many victims are in the video?",
    "compound_victim_bystander_count": "How many people are victimized and how many are just observing?",
    "compound_aggressor_action_victim": "Which of the following best describes what happened in the video?",
    "sequence_verification": "Which of the following sequences best describes the interaction shown in the video?",
    "role_identification": "Concerning the {person}, their role would best be described as:",
}
NEGATIVE_ROLE_PROMPT = "Concerning the people shown, their role would best be described as:"
NULL_ANSWERS = {
    "primary_action": "no aggressive action is taking place",
    "aggressor_identification": "No individual displays aggressive behavior",
    "victim_recognition": "No one appears to be victimized",
    "bystander_detection": "No bystanders are present",
    "perspective_aggressor": "None of the above appear aggressive",
    "scene_location": "Unclear / not shown",
    "interaction_summary": "No meaningful interaction occurs",
    "social_appropriateness": "No actions performed are socially inappropriate",
    "role_count_aggressor": "Unable to determine from the video",
    "role_count_victim": "Unable to determine from the video",
    "role_count_bystander": "Unable to determine from the video",
    "compound_aggressor_location": "Unable to determine aggressor or location",
    "compound_action_victims": "No action; Victim: No one appears to be victimized",
    "compound_action_aggressor": "No action; Aggressor: No aggressor present",
    "compound_action_location": "No action and location unclear",
    "compound_aggressor_victim": "No aggressor described and no victim described",
    "compound_bystander_location": "No bystanders and location unclear",
    "compound_aggressor_victim_count": "0 aggressors and 0 victims",
    "compound_victim_bystander_count": "0 victims and 0 bystanders",
    "compound_aggressor_action_victim": "No one did anything to anyone",
    "role_identification": "No one in the video fits that description",
    "sequence_verification": "No sequences describe the video",
}
REQUIRED_FIELDS = {
    "primary_action": ("action",),
    "aggressor_identification": ("aggressor",),
    "victim_recognition": ("victim",),
    "bystander_detection": ("bystander",),
    "perspective_aggressor": ("aggressor",),
    "scene_location": ("environment",),
    "interaction_summary": ("aggressor", "victim", "action"),
    "social_appropriateness": ("aggressor",),
    "role_count_aggressor": (),
    "role_count_victim": (),
    "role_count_bystander": (),
    "compound_aggressor_location": ("aggressor", "environment"),
    "compound_action_victims": ("action", "victim"),
    "compound_action_aggressor": ("action", "aggressor"),
    "compound_action_location": ("action", "environment"),
    "compound_aggressor_victim": ("aggressor", "victim"),
    "compound_bystander_location": ("bystander", "environment"),
    "compound_aggressor_victim_count": ("aggressor", "victim"),
    "compound_victim_bystander_count": ("victim", "bystander"),
    "compound_aggressor_action_victim": ("aggressor", "action", "victim"),
}
ROLE_LABELS = ("Aggressor", "Victim", "Bystander")
ROLE_NO_MATCH = "No one in the video fits that description"
ROLE_ORDER = ROLE_LABELS + (ROLE_NO_MATCH,)
COUNT_OPTIONS = ("0", "1", "2", "3 or more")
NEGATIVE_TYPES = (
    "aggressor_identification",
    "perspective_aggressor",
    "victim_recognition",
    "bystander_detection",
    "primary_action",
    "social_appropriateness",
    "role_identification",
    "sequence_verification",
    "interaction_summary",
    "compound_aggressor_action_victim",
    "compound_aggressor_location",
    "compound_action_victims",
    "compound_bystander_location",
    "scene_location",
)
CHAIN_TYPES = (
    "compound_aggressor_victim",
    "compound_aggressor_action_victim",
    "compound_action_victims",
    "compound_aggressor_location",
    "compound_action_location",
    "sequence_verification",
    "aggressor_identification",
    "victim_recognition",
)
COUNTING_SOCIAL_TYPES = (
    "role_count_aggressor",
    "role_count_victim",
    "role_count_bystander",
    "compound_aggressor_victim_count",
    "compound_victim_bystander_count",
    "social_appropriateness",
)
CHAIN_MIN_LENGTH = 50
CHAIN_TAIL = 80

# --- fixed values: word lists -------------------------------------------------
NONE_VALUES = ("none", "n/a", "")
NORMAL_NONE_VALUES = ("", "none", "n/a", "na", "unknown")
PEOPLE_NONE_VALUES = ("none", "n/a", "unknown", "")
ACTION_SYNONYMS = {"talking aggressively": "aggressive talking", "grab clothing": "clothing grab"}
GENERIC_TOKENS = (
    "group", "groups", "bystanders", "others", "many", "several", "people",
    "crowd", "everyone", "anyone", "someone", "none", "unknown", "unidentified",
)
GENERIC_PHRASES = (
    "group of", "a group", "others", "no one", "no individual", "no person",
    "no people", "no bystander", "no aggressor", "no victim", "not shown",
    "not visible", "unclear", "unknown",
)
STOP_WORDS = (
    "a", "an", "the", "is", "of", "and", "with", "on", "in", "at", "for",
    "by", "to", "who", "that", "this", "person", "people", "group",
)
ROLE_STOP_WORDS = ("a", "the", "in", "with", "and", "person", "wearing")
NONE_MARKERS = (
    "no one", "no individual", "no actions performed", "no aggressive action",
    "no bystanders", "none of the above", "not shown", "unclear",
    "no one appears", "no one in the video",
)
NONE_KEYWORDS = (
    "no one", "no individual", "no person", "no people", "no bystander",
    "no victim", "no aggressor", "none", "not present", "no action",
    "not shown", "unclear", "not visible", "no meaningful", "no sequence",
)
REFUSAL_PHRASES = (
    "i cannot fulfill", "i'm unable to", "i am unable to", "i cannot assist",
    "i'm not able to", "i am not able to", "i cannot provide",
    "i'm prohibited from", "i am prohibited from",
)
REFUSAL_WINDOW = 200
RUBRIC = (
    "aggression_detection", "action_identification", "aggressor_identification",
    "victim_identification", "reasoning_quality",
)
MEDIA_EXTENSIONS = ("mp4", "avi", "mov", "mkv", "flv", "wmv", "webm")
EXCLUDED_CLIPS = (
    "bodyslam_facebook_001.mp4",
    "indecent__gesture_2_trim_0.mp4",
    "tackle_1_trim_2.mp4",
    "tackle_2_trim_1.mp4",
)

# --- fixed values: patterns that read a rendered option back into its slots ----
SLOT_PATTERNS = {
    "compound_aggressor_action_victim": (r"(?i)^(.+?)\s+performed\s+(.+?)\s+on\s+(.+)$", ("agg", "act", "vic")),
    "interaction_summary": (
        r"(?i)^(.+?)\s+performs\s+(?:the\s+)?action\s+of\s+(.+?)\s+on\s+(.+)$", ("agg", "act", "vic")),
    "sequence_verification": (
        r"(?i)^(.+?),\s*who\s+is\s+the\s+aggressor,\s*performed\s+the\s+action\s+of\s+(.+?)\s+against\s+(.+)$",
        ("agg", "act", "vic")),
    "compound_aggressor_victim": (r"(?i)^\s*aggressor:\s*(.+?);\s*victim:\s*(.+?)\s*$", ("agg", "vic")),
    "compound_action_victims": (r"(?i)^\s*([^;]+?);\s*victim:\s*(.+?)\s*$", ("act", "vic")),
    "compound_action_aggressor": (r"(?i)^\s*([^;]+?);\s*aggressor:\s*(.+?)\s*$", ("act", "agg")),
    "compound_aggressor_location": (r"(?i)^(.+?)\s+in\s+(.+)$", ("agg", "loc")),
    "compound_bystander_location": (r"(?i)^.+?\s+in\s+(.+)$", ("loc",)),
    "social_appropriateness": (r"(?i)^the\s+action\s+performed\s+by\s+(.+)$", ("agg",)),
}
LOCATION_UNCLEAR_PATTERN = r"(?i)^(.+?);\s*location\s+unclear\s*$"
PERSON_PROPERTY = r"person (?:in |wearing |with )[\w\s,]+?(?=\s+(?:performed|performs|committed|who|;|$))"
ACTION_PROPERTY = r"(?:performed|performs|committed|action of)\s+([\w\s]+?)(?:\s+(?:on|against|to)\b|$)"
