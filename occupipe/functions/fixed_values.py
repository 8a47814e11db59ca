"""Word lists, patterns, phrases and constants whose values decide results.

Everything below is a fixed value: changing one changes output.
"""

# --- verb test ---------------------------------------------------------------
NOT_VERBS = ["proven", "possess"]
VERBS = ["review", "responsible", "design", "to", "able"]
ADDRESS_PREFIXES = ["you are", "are you"]

# --- list choice -------------------------------------------------------------
MERGE_BELOW_ITEMS = 6
MERGE_FROM_SCORE = 0.7
SHORT_LIST_ITEMS = 3
SHORT_LIST_CAP = 0.5
ACCEPT_SCORE = 0.5

# --- document length thresholds, in words ------------------------------------
MIN_WORDS_DOCUMENT = 100
MIN_WORDS_EXTRACT = 50

# --- paragraph that opens a list item ----------------------------------------
BULLET_START = "^ *(•|-|·|[0-9]+)"

# --- entities decoded inside extracted blocks --------------------------------
ENTITIES = {
    "&nbsp;": " ",
    "&rsquo;": "’",
    "&lsquo;": "‘",
    "&ldquo;": "“",
    "&rdquo;": "”",
    "&bull;": "•",
    "&middot;": "·",
    "&ndash;": "–",
    "&mdash;": "—",
    "&hellip;": "…",
    "&quot;": '"',
    "&apos;": "'",
    "&#39;": "'",
    "&#8217;": "’",
    "&#8226;": "•",
    "&#183;": "·",
    "&#160;": " ",
    "&copy;": "©",
    "&reg;": "®",
    "&trade;": "™",
}

# --- title cleaning, applied in this order, each match becoming a space -------
TITLE_PATTERNS = [
    r"\[.*?\]",
    r"\(.*?\)",
    r"#sgunitedjobs*",
    r"^\d{2,5}",
    r"-",
    r"#sgunitedtraineeships",
    r"#sgups*",
    r"#sguniteds*",
    r"#sg",
    r"#(\w+)",
    r"\d{4,}",
]

# --- cleaning of taxonomy title lists: pattern, replacement --------------------
TITLE_LIST_REPLACEMENTS = [
    ("•", ""),
    ("\n", "."),
    ("<Blank>", ""),
    (r"\([A-Za-z0-9 /.,*&'-]+\)", ""),
]

# --- payload returned by the records service for an unknown id ------------------
NOT_FOUND_MESSAGE = "UUID is not found in the database."
REQUIRED_KEYS = [
    "uuid",
    "title",
    "description",
    "minimumYearsExperience",
    "numberOfVacancies",
]

# --- top-n and loss weight per level, and the least probability in a loss ---------
TOP_N = {1: 2, 2: 5, 3: 5, 4: 5, 5: 10}
LEVEL_LOSS_WEIGHTS = {1: 20.0, 2: 5.0, 3: 3.0, 4: 2.0, 5: 1.0}
PROBABILITY_FLOOR = 1e-15

# --- link domains left out of link lists -----------------------------------------
BLOCKED_LINK_PREFIXES = [
    "https://www.google.",
    "https://google.",
    "https://webcache.googleusercontent.",
    "http://webcache.googleusercontent.",
    "https://policies.google.",
    "https://support.google.",
    "https://maps.google.",
]

# --- phrases injected by augmentation ---------------------------------------------
COMMON_PHRASES = [
    " We are looking for/searching for a candidate who is",
    " We are looking for a candidate who can",
    " Are you passionate about this job",
    " Do you love a job that",
    " We are a company that",
    " We are a startup that",
    " We are a agency that",
    " Would you like to work for a company that is",
    " Are you interested in working for a company that",
    " In this role, you will be responsible for",
    " One of your key responsibilities in this job will be",
    " If you love this role, then you’ll fit right in our team of",
    " If you would like to be part of our team, apply today by",
    " Sound like you? Then, send your resumé/CV and cover letter to",
    " If this sounds like you, then apply by clicking the button below",
    " Description of the duties and responsibilities of the job includes",
    " This job is ideal for someone who is",
    " Top skills and proficiencies include",
    " Dynamic work environment",
    " Proven track record",
    " Must be a self-starter",
    " Detailed orientated",
    " Requires to have good communication skills",
    " We are looking for a candidate who works independently",
]

# --- augmentation and masking parameters ------------------------------------------
AUGMENT_SHARE = 0.5
AUGMENT_MIN_WORDS = 10
NEAREST_WORDS = 5
MASK_SHARE = 0.15
IGNORE_LABEL = -100
SEQUENCE_LENGTH = 512
