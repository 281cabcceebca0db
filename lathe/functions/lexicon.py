"""Word lists, patterns and thresholds. Functions take them as parameters; these are the defaults."""

from __future__ import annotations

# Results depend on them.
MODAL_STRENGTH = {"shall": 3, "must": 3, "should": 2, "will": 2, "may": 1, "can": 1}
MODAL_ORDER = ["shall", "must", "should", "will", "may", "can"]
CONFORMANCE_MODALS = ["shall", "should", "must", "may", "will"]
TRIGGERS = ["when", "if", "while", "where"]
EARS_PREFIXES = {"WHEN ": "EventDriven", "WHILE ": "StateDriven", "WHERE ": "OptionalFeatures", "IF ": "UnwantedBehavior"}
UBIQUITOUS_WORDS = ["SHALL", "SHOULD", "MUST"]
DETAIL_STOPWORDS = ["the", "a", "an", "of", "in", "on", "at", "to", "for", "and", "or", "is", "are"]
DISTRACTOR_STOPWORDS = ["a", "an", "the", "and", "or", "in", "to", "of", "for", "with", "by", "at", "on"]
BOILERPLATE = [
    "when", "if", "while", "where", "shall", "should", "must", "may", "will", "can", "the", "system", "a", "an", "is", "are", "be", "to", "of",
    "and", "or", "in", "that", "it", "this", "for", "with", "by", "not", "no", "then", "ubiquitous", "event", "driven", "unwanted", "behavior",
    "state", "optional", "feature",
]
SIMILARITY_THRESHOLD = 0.75
READABILITY_DELTA_MAX = 3.0
DIRECTIONAL_DELTA_MIN = 0.5
DIRECTIONAL_OVERLAP_MAX = 0.95
DETAIL_SHARE_MIN = 0.7
DISTRACTOR_SHARE_MAX = 0.5
SEMANTIC_F1_MIN = 0.85
MIN_WORDS, MAX_WORDS = 8, 60
MAX_PER_DOC, MAX_TOTAL, NEAR_DUP_CHARS, TARGET_WORDS = 20, 600, 60, 25
SENTENCE_KEY_CHARS = 80
REQUIREMENT_CLASSES = {
    "F": "Functional", "A": "Availability", "L": "Legal", "LF": "Look and Feel", "MN": "Maintainability", "O": "Operational", "PE": "Performance",
    "SC": "Scalability", "SE": "Security", "US": "Usability", "FT": "Fault Tolerance", "PO": "Portability",
}
CEFR_NAMES = {"a2": "A2 (elementary)", "b1": "B1 (intermediate)"}
ANAPHORIC_STARTS = ["he", "she", "it", "they", "his", "her", "its", "their", "this", "these", "those", "such"]
ANAPHORIC_PHRASES = ["this was", "this has", "this is", "these are", "those are", "it has been", "it was found", "they have", "they were", "the former", "the latter", "such as this"]

MODAL_SYNONYMS = {
    "shall": ["is required to", "must"],
    "must": ["is required to", "shall"],
    "should": ["is expected to", "ought to"],
    "will": ["is going to", "shall"],
    "may": ["is permitted to", "is allowed to"],
    "can": ["is able to", "is capable of"],
}
MODAL_WEAKEN = {"shall": "should", "must": "should", "should": "may", "will": "may", "can": "may"}
MODAL_STRENGTHEN = {"may": "should", "can": "should", "should": "shall", "will": "shall"}
STRENGTH_PHRASES = [
    ("it is required that", 3), ("is required to", 3), ("shall be required", 3), ("is expected to", 2), ("ought to", 2),
    ("is permitted to", 1), ("is allowed to", 1), ("is able to", 1), ("is capable of", 1),
]
CONDITION_STRENGTHENERS = [
    ("fails", "fails twice"), ("fails", "fails repeatedly"), ("exceeds", "significantly exceeds"), ("occurs", "occurs repeatedly"),
    ("detected", "detected multiple times"), ("invalid", "invalid or expired"), ("missing", "missing or corrupted"),
    ("timeout", "timeout or connection failure"),
]
CONDITION_WEAKENERS = [
    ("fails twice", "fails"), ("fails repeatedly", "fails"), ("always", "sometimes"), ("all", "some"), ("every", "some"),
    ("mandatory", "optional"), ("required", "recommended"), ("immediately", "eventually"),
]
CONDITION_KEYWORDS = ["if", "when", "while", "where", "unless", "fails", "exceeds", "occurs", "detected"]
CONDITION_SYNONYMS = {
    "when": ["once", "after"],
    "while": ["as long as"],
    "if": ["in the event that", "in case"],
    "where": ["in cases where", "whenever"],
    "unless": ["except when", "if not"],
}
SUBJECT_EXPANSIONS = [
    ("The system", "The software system"), ("The user", "The end user"), ("The application", "The software application"),
    ("The component", "The software component"), ("The module", "The software module"),
]
DISTRACTOR_CUES = [
    ("retry_trigger", ["fail", "error", "invalid", "reject", "deny", "timeout", "unavailable"]),
    ("escalation_trigger", ["access", "login", "authenticate", "permission", "unauthori"]),
    ("scope_trigger", ["all", "every", "each", "any", "user", "participant", "client"]),
]
DISTRACTOR_DEFAULT = "response_trigger"
DISTRACTORS = {
    "retry_trigger": ["temporarily", "intermittently", "transiently", "momentarily"],
    "escalation_trigger": ["unexpectedly", "without warning", "without prior notice", "without authorization"],
    "scope_trigger": ["under all circumstances", "in all cases", "regardless of context", "at all times"],
    "response_trigger": ["and log the event", "and notify the administrator", "and send a confirmation", "and generate a report"],
}
HALLUCINATION_RISK = {
    "retry_trigger": "hallucinate retry or recovery action",
    "escalation_trigger": "hallucinate escalation or notification step",
    "scope_trigger": "hallucinate scope expansion to all cases",
    "response_trigger": "hallucinate additional system response",
}
REWRITE_MODALS = [("shall", "SHALL"), ("must", "SHALL"), ("should", "SHOULD"), ("will", "SHALL"), ("may", "MAY"), ("can", "MAY")]
REWRITE_TRIGGERS = [(r"\bif\b", "IF"), (r"\bwhen(ever)?\b", "WHEN"), (r"\bwhile\b", "WHILE"), (r"\bonce\b", "WHEN"), (r"\bafter\b", "WHEN")]

# Patterns of the text repairs, by step.
MODAL_GATE = r"\b(shall|should|must|may|will|can|cannot|is required|are required)\b"
TILDE_METADATA = r"\s*~[^~]{0,80}~?\s*$"
THEN_TAIL = r"(?i)\.\s+Then[,\s].*$"
BULLET = r"^[•·▪▸►\-–—]\s+"
CONNECTIVES = (
    r"(?i)^(therefore[,\s]+|moreover[,\s]+|however[,\s]+|additionally[,\s]+|furthermore[,\s]+|also[,\s]+|note that[,\s]+|"
    r"requirement specification:\s+|with this in mind[,\s]+|as a result[,\s]+|consequently[,\s]+)"
)
ID_PREFIX = r"(?i)^(?:([A-Z0-9]{2,12}-[A-Z0-9]{2,8}-?[A-Z0-9]{0,8}\d*\s+)|(\d+(\.\d+){1,4}\s+[A-Z][a-z]))"
ID_PREFIX_REPAIRED = r"^(?:([A-Z0-9]{2,12}-[A-Z0-9]{2,8}-?[A-Z0-9]{0,8}\d*\s+)|(\d+(\.\d+){1,4}\s+(?=[A-Z][a-z])))"
SECTION_PREFIX = r"^\d+(\.\d+)*\s+[A-Za-z\s]{3,40}:\s*[-–]?\s*"
TABLE_HEADER = r"(?i)^[\w\s]{2,20}(req\s*id|requirement\s*(id|statement)|use\s*case|id\s+requirement|statement\s+use)\s+\w{1,10}\d+\s+"
INLINE_REFERENCE = r"\(\s*(?:see\s+)?\d+(\.\d+)+\s*\)"
TRAILING_REFERENCE = r"\s*\(\s*\d+(\.\d+)+\s*\)\s*\.?$"
OPTIONALITY = r"\s*\([OMR]\)\s*"
FOOTNOTE = r"\.\d{1,3}\s+[A-Z]"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z])"
PRIORITY = r"(?i)Priority\s+(\d)"
TITLE_FRAGMENT = r"^[A-Z][A-Za-z\s\-/]+?(?=\s+[A-Z][a-z]|\s+The\s|\s+If\s|\s+When\s|\s+WHEN|\s+WHERE)"
REQUIREMENT_ID = r"\b((?!19\d\d|20\d\d)[0-4]\d{3})\b"

# Reasons to reject a text, in the order in which they are tried.
REJECT_RULES = [
    ("context_opener", r"(?i)^(for example|therefore|moreover|however|but if|additionally|furthermore|in addition|as a result|consequently|thus|hence|as mentioned|as described|as noted|as stated|as specified above|as follows|in this case|in such cases|this means|with this in mind)\b"),
    ("pronoun_subject", r"(?i)^(it |he |she |they |them |this |these |those |its )"),
    ("second_person_subject", r"(?i)^(you (can|should|must|may|will|are|have)|after you |once you |when you |if you )"),
    ("deleted_marker", r"(?i)intentionally deleted|deliberately deleted|this (page|section) (is )?intentionally"),
    ("glossary_definition", r"^[A-Z][A-Za-z\s/\-]{2,40}[–—-]\s+[A-Z]"),
    ("doc_header_noise", r"(?i)\bSRS\s+\d+\b|\bpage\s+\d+\b|\bversion\s+\d+\.\d+\b"),
    ("truncated_list", r":\s*$|:\s*\d+\.\s*$|,\s*\d+\.\s*$|\(\s*[Mm]\s*\)\s*\d+\."),
    ("non_system_statement", r"(?i)^(workshops? will\b|all people are\b|everyone (that|who)\b|users? are (assumed|expected|required) to have\b|this document (explains|describes|outlines)\b|the (whole|entire) project is based\b|this (srs|specification|document) (describes|explains|defines)\b)"),
    ("metadata_template_dump", r"(?i)\b(actors?|post conditions?|alternate course|exceptional course|req id|origin:|priority:\s*\d|process source|related reqs?|category:|systems?:|users?:)\b"),
    ("assumption_entry", r"(?i)^it is (assumed|expected|understood|presupposed) that\b|^(the system|this document) assumes?\b|^assumptions?:\s"),
    ("ocr_corruption", r"\b[a-zA-Z]{1,3}\s[a-zA-Z]{1}\s[A-Z]\b|[•·▪]{2,}|\$[A-Z_]+/|extern\s+\w+\s+\w+\s*\(|/\*[*\s]{5,}"),
    ("source_code_block", r"(?i)(\$[A-Z_]+/[\w/\.]+)|(extern\s+\w+\s+\w+\s*\()|(/\*[\*\s]{3,})|(\w+\.\w+\(\))|(#include\s*<)|(\{\s*/\*)"),
    ("table_row_dump", r"(?i)(req\s*id|use\s*case|req\s*statement).{0,60}(req\s*id|use\s*case|must\s+be\s+able)"),
    ("doc_authoring_instruction", r"(?i)^(if this section is empty|fill in|insert here|keep in mind that|describe (here|below)|to be (filled|completed|written)|add (here|description)|write (here|the))\b"),
    ("citation_prose", r"(?i)^[\d\w\s]+ (notes?|states?|specifies?|indicates?|requires?|says?) that\b"),
    ("use_case_scenario", r"(?i)\b(after \w+ (discards?|clicks?|selects?|enters?|presses?))\b"),
    ("db_record_dump", r"(?i)(req id|name:|description:|related reqs?|process source).{0,30}(req id|name:|description:|related reqs?|process source)"),
    ("versioning_statement", r"(?i)\b(will be numbered|document will be (updated|revised|released|versioned)|next (release|version) (of|will)|numbered \d+\.\d+)\b"),
    ("user_intention_not_req", r"(?i)\b(may want to|might want to|could want to|users? (may|might|could) (wish|want|like|prefer) to)\b"),
    ("section_tag_merge", r"\.\s+\d+\.\d+(\.\d+)*\s+[A-Z]"),
    ("architectural_description", r"(?i)^(the \w+ (is responsible for|is designed to|is intended to|consists? of|is composed of|is made up of|is used to|serves? as|acts? as|functions? as))"),
    ("doc_management_statement", r"(?i)\b(requirements? (will be|shall be) (reviewed|updated|refined|added|removed|maintained|documented|tracked))\b|\b(this document|this specification|this srs) (will|shall) be\b"),
]
#: Reasons whose pattern has to occur so often.
REJECT_COUNTS = {"metadata_template_dump": 2}
NON_ASCII_SHARE = 0.05
EXTERNAL_REFERENCE = r"(?i)\[[\w\-\s]+\]|appendix\s+[A-Z]\b|per\s+\[|as\s+per\s+\[|see\s+\[|refer\s+to\s+\["
