"""Default lexicons.

FIXED VALUES.  Everything in this module is vocabulary that must equal the
original directory tool's for equal results: dictionaries of practices,
offices, industries, regions, titles, section headers, stop words, keyword
lists and the regular expressions used to pick fields out of text.  They are
stated here once, plainly and in their original order; every job takes them
as arguments, so a caller may pass another firm's vocabulary instead.
"""

from __future__ import annotations

import sys

# ---------------------------------------------------------------- FIXED VALUES
# Dictionaries searched as case-sensitive substrings of the page text.
PRACTICES = [
    "Antitrust & Competition",
    "Capital Markets",
    "Civil Litigation",
    "Corporate",
    "Corporate Governance",
    "Data Privacy & Cybersecurity",
    "Derivatives & Structured Products",
    "Environmental",
    "Executive Compensation",
    "Finance",
    "Financial Institutions",
    "Investment Management",
    "IP & Commercial Transactions",
    "IP Litigation",
    "Liability Management & Special Opportunities",
    "Litigation",
    "Mergers & Acquisitions",
    "Private Credit",
    "Private Equity",
    "Private Wealth",
    "Public Company Advisory",
    "Real Estate",
    "Restructuring",
    "Shareholder Activism Defense",
    "Sponsor Finance",
    "Tax",
    "White Collar Defense & Investigations",
]

OFFICES = [
    "New York",
    "Northern California",
    "Washington DC",
    "São Paulo",
    "London",
    "Brussels",
    "Madrid",
    "Hong Kong",
    "Beijing",
    "Tokyo",
]

INDUSTRIES = [
    "Artificial Intelligence",
    "Cleantech",
    "Consumer Products & Retail",
    "Data Centers & Digital Infrastructure",
    "Energy, Power & Infrastructure",
    "Fintech & Cryptocurrency",
    "Healthcare & Life Sciences",
    "Industrials",
    "Sports",
    "Tech, Media & Telecom",
]

# Regions are only looked for inside Capabilities sections.
REGIONS = ["Asia", "China", "Japan", "Europe", "Latin America", "Israel"]

# Title keywords, most specific first.
TITLE_KEYWORDS = [
    "Managing Partner",
    "Senior Partner",
    "Senior Counsel",
    "Of Counsel",
    "Partner",
    "Counsel",
    "Associate",
    "Co-Head",
    "Head",
]

# Text that is never a person's name (equality or substring, lower-cased).
NAME_BLACKLIST = [
    "print this page", "download address card", "back to top", "back to",
    "lawyers", "capabilities", "insights", "experience", "education",
    "languages", "clerkship", "qualifications", "prior experience",
    "about us", "offices", "careers", "contact", "search", "clear",
    "skip to main content", "top of page", "receive insights",
    "subscribe", "explore", "connect", "legal", "privacy notice",
    "cookie policy", "cookie settings", "attorney advertising",
    "prior results do not guarantee", "davis polk", "davis polk & wardwell",
    "managing partner", "senior partner", "senior counsel", "of counsel",
    "partner", "counsel", "associate", "co-head", "head",
    "new york", "northern california", "washington dc", "são paulo",
    "london", "brussels", "madrid", "hong kong", "beijing", "tokyo",
    "asia", "china", "japan", "europe", "latin america", "israel",
    "order of the coif", "magna cum laude", "summa cum laude", "cum laude",
    "phi beta kappa", "with honors", "with distinction", "high honors",
    "admitted to practice", "bar admission", "law review", "moot court",
]

# Shorter list used when a stored name is checked at write time / repair time.
STORED_NAME_BLACKLIST = [
    "print this page", "download address card", "back to top", "back to",
    "lawyers", "capabilities", "insights", "experience", "education",
    "skip to main content", "top of page", "davis polk",
]

# Characters that disqualify a name.
NAME_BAD_CHARS = ["@", "+", "(", ")", "/", ":", ";", "=", "?"]

# Shape of a valid name and of a name line.
NAME_SHAPE = r"^[A-Z][a-zA-Z.\s]+$"
NAME_LINE = r"^([A-Z][a-z]+(\s+[A-Z]\.?\s*)?(\s+[A-Z][a-z]+)+)$"

# Profile URL slug and name-part rules.
URL_SLUG = r"/lawyers/([a-z0-9\-]+)/?$"
ROMAN_PARTS = ["ii", "iii", "iv", "v", "vi"]
SUFFIX_PARTS = ["jr", "sr"]

# E-mail and phone patterns.
PHONE_PATTERNS = [
    r"\+1\s*\d{3}\s*\d{3}\s*\d{4}",
    r"\+\d[\s\d\-\(\)]+\d",
    r"\(\d{3}\)\s*\d{3}[\-\s]\d{4}",
    r"\d{3}[\-\.\s]\d{3}[\-\.\s]\d{4}",
]

# Section headers and the words that close each section.
EDUCATION_HEADER = "Education"
EDUCATION_STOPS = ["Clerkship", "Qualification", "Experience", "Insights", "Back to"]
EDUCATION_DEGREE_MARKS = ["J.D.", "LL.M.", "LL.B.", "B.A.", "B.S.", "A.B.", "M.A.", "M.S.", "MBA", "Ph.D."]
EDUCATION_SCHOOL_WORDS = ["University", "College", "School", "Institute"]
EDUCATION_MAX_LEN = 100

CLERKSHIP_HEADER = "Clerkship"
CLERKSHIP_STOPS = ["Qualification", "Experience", "Education", "Back to", "Insights"]
CLERKSHIP_WORDS = ["Clerk", "Judge", "Hon.", "Court"]

CAPABILITIES_HEADER = "Capabilities"
CAPABILITIES_STOPS = [
    "Experience", "Education", "Insights", "Languages", "Prior experience",
    "Clerkship", "Qualifications", "Back to", "Download", "Print",
]
CAPABILITIES_SKIPS = ["view", "see more", "download", "print", "back to", "address card"]

LANGUAGE_HEADER = "Language"
LANGUAGE_STOPS = ["Experience", "Education", "Qualifications", "Prior experience", "Back to"]
LANGUAGES = [
    "English", "Spanish", "French", "German", "Mandarin", "Cantonese",
    "Japanese", "Korean", "Italian", "Portuguese", "Russian", "Arabic",
    "Hindi", "Dutch", "Swedish", "Norwegian", "Hebrew", "Greek",
    "Bosnian", "Serbian", "Croatian", "Serbo-Croatian", "Turkish", "Polish",
    "Czech", "Romanian", "Bulgarian", "Hungarian", "Finnish", "Danish",
    "Icelandic", "Farsi", "Urdu", "Bengali", "Thai", "Vietnamese",
    "Indonesian", "Malay", "Tagalog", "Swahili", "Afrikaans", "Zulu",
    "Chinese", "Catalan", "Basque", "Gaelic", "Welsh", "Albanian",
    "Armenian", "Georgian", "Ukrainian", "Belarusian", "Slovak", "Slovenian",
    "Macedonian", "Maltese", "Estonian", "Latvian", "Lithuanian",
]

# Experience section.
EXPERIENCE_HEADER = "Experience"
EXPERIENCE_HEADER_MAX_LEN = 20
EXPERIENCE_STOPS = [
    "Education", "Languages", "Qualifications", "Prior experience",
    "Clerkship", "Back to", "Download", "Print", "Offices",
    "News", "Contact", "Careers", "Alumni", "Connect", "Archive",
]
EXPERIENCE_KEEP_LINE = "Prior experience"
EXPERIENCE_NAV = [
    "Skip to main content", "Top of page", "Davis Polk",
    "Lawyers", "Capabilities", "Insights", "Client Updates",
    "Webinars & CLE Programs", "Resource Centers", "Offices",
    "About Us", "Overview", "Business Services Leadership",
]
EXPERIENCE_SKIPS = [
    "view more experience", "see more experience", "download", "print", "back to",
    "address card", "skip to", "see all results",
]
EXPERIENCE_MIN_LEN = 50
NAV_LOOKBACK = 5

# Education tokenizer: degrees in list order (law, undergraduate, graduate).
LAW_DEGREES = ["J.D.", "LL.M.", "LL.B.", "J.D", "LL.M", "LL.B"]
UNDERGRAD_DEGREES = ["B.A.", "B.S.", "A.B.", "B.A", "B.S", "A.B"]
GRAD_DEGREES = ["M.A.", "M.S.", "MBA", "Ph.D.", "M.A", "M.S", "Ph.D"]
SCHOOL_PATTERNS = [
    r"([A-Z][^,]+(?:University|College|School|Institute)[^,]*?)",
    r"([A-Z][^,]+(?:Law School|Law)[^,]*?)",
]
SCHOOL_FALLBACK_SKIP = ["tax", "economics", "law"]
SCHOOL_FALLBACK_MIN_LEN = 5
HONORS = ["magna cum laude", "summa cum laude", "cum laude", "with honors", "with distinction"]

# Keyword extraction for the complex path.
COMPANY_PATTERNS = [
    r"\b(?:CNN|NBC|Fox|ABC|CBS|HBO|ESPN|MTV)\b",
    r"\b(?:Netflix|Hulu|Disney\+?|Amazon\s*Prime|Apple\s*TV)\b",
    r"\b(?:Google|Apple|Microsoft|Amazon|Facebook|Meta|Tesla)\b",
    r"\b(?:Goldman\s*Sachs|JPMorgan|Morgan\s*Stanley|Bank\s*of\s*America)\b",
    r"\b(?:Pfizer|Moderna|Johnson\s*&\s*Johnson|Merck)\b",
]
INDUSTRY_KEYWORDS = [
    "television", "broadcast", "tv", "network", "media", "streaming",
    "cryptocurrency", "crypto", "bitcoin", "blockchain", "digital asset",
    "pharmaceutical", "pharma", "drug", "clinical", "fda",
    "technology", "tech", "software", "startup",
    "ipo", "public offering", "merger", "acquisition",
    "litigation", "lawsuit", "dispute", "court", "trial",
    "fortune 500", "fortune500",
]
QUOTED_PHRASE = r'"([^"]+)"'
CAPITALISED_ENTITY = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"

# Adaptive candidate pool and filter thresholds.
POOL_K_MANY, POOL_K_SOME, POOL_K_NONE = 30, 40, 50
STRICT_KEYWORDS, STRICT_HITS, RELAX_BELOW = 3, 2, 5
FALLBACK_TOP = 20
PREVIEW_CHARS = 200
EMBED_BATCH = 10

# Query routing.
SIMPLE_PATTERNS = [
    r"\b(named|called|with name)\b",
    r"\b(went to|graduated from|attended|studied at)\s+\w+",
    r"\b(partner|associate|counsel|senior)s?\b",
    r"\b(speak|speaks|speaking)\s+\w+",
    r"\b(graduated|graduation)\s+(after|before|in)\s+\d{4}",
    r"\b(office|location|based|located)\s+(in|at)",
    r"\b(practice|practices|area)\b",
    r"^\w+\s+\w+$",
]
COMPLEX_PATTERNS = [
    r"\b(worked on|represented|defended|prosecuted|handled)\b",
    r"\b(case|deal|transaction|matter|litigation|ipo|merger|acquisition)\b",
    r"\b(experience|expertise|background)\s+(with|in)\b",
    r"\b(fortune\s*500|tech\s*(company|companies|startup)|pharma|bank)\b",
    r"\b(tv\s*network|streaming|broadcast|media)\b",
]

# Criteria extraction from query text: (pattern, op), first match wins.
YEAR_PATTERNS = [
    (r"graduated\s+after\s+(\d{4})", "gt"),
    (r"graduated\s+before\s+(\d{4})", "lt"),
    (r"graduated\s+in\s+(\d{4})", "eq"),
    (r"graduated\s+(\d{4})", "eq"),
    (r"graduated\s+after\s+(\d{4})", "gt"),
    (r"law\s+school\s+after\s+(\d{4})", "gt"),
    (r"law\s+school\s+before\s+(\d{4})", "lt"),
    (r"law\s+school\s+in\s+(\d{4})", "eq"),
]
NAME_PATTERNS = [r"lawyers?\s+named\s+([a-z\s]+)", r"name\s+is\s+([a-z\s]+)", r"name\s+([a-z\s]+)"]
SCHOOL_QUERY_PATTERNS = [
    r"went\s+to\s+([a-z\s]+)",
    r"graduated\s+from\s+([a-z\s]+)",
    r"from\s+([a-z\s]+)",
    r"school\s+is\s+([a-z\s]+)",
    r"lawyers?\s+who\s+went\s+to\s+([a-z\s]+)",
]
SCHOOL_ARTICLES = r"\b(and|the|a|an)\b"
PRACTICE_QUERY_PATTERNS = [
    r"practice\s+([a-z\s&]+)",
    r"in\s+([a-z\s&]+)",
    r"lawyers?\s+in\s+([a-z\s&]+)",
    r"practice\s+type\s+is\s+([a-z\s&]+)",
]
TITLE_QUERY_PATTERNS = [
    (r"\bmanaging\s+partners?\b", "Managing Partner"),
    (r"\bsenior\s+partners?\b", "Senior Partner"),
    (r"\bsenior\s+counsel\b", "Senior Counsel"),
    (r"\bof\s+counsel\b", "Of Counsel"),
    (r"\bco-?heads?\b", "Co-Head"),
    (r"\bpartners?\b", "Partner"),
    (r"\bcounsel\b", "Counsel"),
    (r"\bassociates?\b", "Associate"),
    (r"\bheads?\b", "Head"),
]
TITLE_IS_PATTERN = r"title\s+is\s+([a-z\s\-]+)"
REGION_QUERY_PATTERNS = [
    r"in\s+(asia|china|japan|europe|latin\s+america|israel)",
    r"region\s+is\s+([a-z\s]+)",
]
LANGUAGE_QUERY_PATTERNS = [
    r"lawyers?\s+who\s+speak\s+([a-z\s\-]+)",
    r"speak\s+([a-z\s\-]+)",
    r"language\s+is\s+([a-z\s\-]+)",
    r"languages?\s+([a-z\s\-]+)",
]
CLAUSE_SPLIT = r"\s+and\s+"
QUERY_STOP_WORDS = ["the", "a", "an", "and", "or", "who", "that", "is", "are", "lawyers", "lawyer"]
FALLBACK_MIN_WORD_LEN = 3
# ------------------------------------------------------------ END FIXED VALUES

# Python's str.strip() whitespace set, built from the rule rather than listed.
PY_WHITESPACE = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())
