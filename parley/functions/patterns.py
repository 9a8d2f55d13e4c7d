"""Rule vocabulary: the patterns, word lists and domains the operators are configured with.

Everything in this module is data. Operators compile these strings into Catalyst
expressions (``rlike``, ``regexp_replace``, ``regexp_count``), so no Python runs per row.

Patterns are written for the JVM regex engine. ``ci()`` adds the flags that make Java
behave like a Unicode-aware, case-insensitive matcher: ``(?i)`` folds case and ``(?U)``
makes ``\\w``, ``\\b`` and ``\\s`` Unicode classes (``(?U)`` implies Unicode case folding).
"""
from __future__ import annotations

import unicodedata


def ci(pattern: str) -> str:
    """Case-insensitive, Unicode-aware JVM pattern."""
    return "(?iU)" + pattern


def _alternatives(pattern: str) -> list[str]:
    """The pattern cut at the bars outside groups and classes."""
    out, depth, start, i, inside = [], 0, 0, 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 1
        elif inside:
            inside = ch != "]"
        elif ch == "[":
            inside = True
            i += pattern[i + 1:i + 2] == "]"
        elif ch in "()":
            depth += 1 if ch == "(" else -1
        elif ch == "|" and not depth:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:]]


def _group_end(pattern: str) -> int:
    """Index after the group that the pattern begins with."""
    for i in range(1, len(pattern) + 1):
        if pattern[i - 1] == ")" and _alternatives(pattern[:i] + "|")[1:] == [""]:
            return i
    return len(pattern)


def grouped(pattern: str) -> str:
    """The same texts match, faster: alternatives with one first letter (or word boundary)
    are tried together, so most positions of a text are settled by a few letters instead of
    by every alternative. Which of several alternatives matches at a place may change, so this
    is for tests whether there is a match, and for counts of whole words."""
    parts: dict[str, list[str]] = {}
    for k, alt in enumerate(_alternatives(pattern)):
        first = "\\b" if alt.startswith("\\b") else alt[:1] if alt[:1].isalpha() else ""
        rest = alt[len(first):]
        if not first or rest[:1] in ("?", "*", "+", "{"):
            first, rest = f" {k}", alt  # stays by itself
        parts.setdefault(first, []).append(rest)
    out = []
    for first, rests in parts.items():
        if first[0] != " ":
            rest = grouped("|".join(rests)) if rests != [""] else ""
            out.append(first + (rest if len(_alternatives(rest)) == 1 else f"(?:{rest})"))
            continue
        alt, open_ = rests[0], next((o for o in ("(?:", "(") if rests[0].startswith(o)), "")
        if open_ and not alt.startswith("(?") or open_ == "(?:":
            end = _group_end(alt)
            alt = open_ + grouped(alt[len(open_):end - 1]) + alt[end - 1:]
        out.append(alt)
    return "|".join(out)


def uni(pattern: str) -> str:
    """Case-sensitive, Unicode-aware JVM pattern."""
    return "(?U)" + pattern


# ---------------------------------------------------------------------------
# FIXED VALUES. These must equal the reference for matching results; they are
# stated as text, in their natural order.
# ---------------------------------------------------------------------------

# Domains
INTENTS = [
    "software_feature_defect",
    "general_complaint_nonactionable",
    "billing_account",
    "battery_drain",
    "non_english",
    "out_of_scope",
    "ios_version_downgrade",
]
# First-pass labeler knows only six classes, in this order of definition.
FIRST_PASS_INTENTS = [
    "software_feature_defect",
    "ios_version_downgrade",
    "battery_drain",
    "billing_account",
    "general_complaint_nonactionable",
    "non_english",
]
# Model label parse order (first contained class wins).
PARSE_ORDER = [
    "software_feature_defect",
    "ios_version_downgrade",
    "battery_drain",
    "billing_account",
    "general_complaint_nonactionable",
    "non_english",
    "out_of_scope",
]
RESIDUAL = "general_complaint_nonactionable"
OUT_OF_SCOPE = "out_of_scope"
RESOLUTION_TYPES = [
    "other_channel_redirect",
    "answer_with_dm_followup",
    "self_contained_answer",
    "dm_handoff",
    "clarifying_question",
    "other",
]
ANSWER_TYPES = ["self_contained_answer", "answer_with_dm_followup"]

# Production prevalence used for reweighting (estimated corpus mix).
PREVALENCE = {
    "software_feature_defect": 0.353,
    "general_complaint_nonactionable": 0.371,
    "billing_account": 0.087,
    "battery_drain": 0.113,
    "non_english": 0.022,
    "out_of_scope": 0.050,
    "ios_version_downgrade": 0.005,
}

# Retrieval policy per intent: (policy, acceptable resolution types).
POLICY = {
    "software_feature_defect": ("required", ["self_contained_answer", "answer_with_dm_followup"]),
    "battery_drain": ("required", ["self_contained_answer", "answer_with_dm_followup"]),
    "general_complaint_nonactionable": ("required", ["clarifying_question"]),
    "billing_account": ("escalate", ["other_channel_redirect", "dm_handoff"]),
    "non_english": ("escalate", ["other_channel_redirect"]),
    "ios_version_downgrade": ("none", []),
    "out_of_scope": ("none", []),
}
EXPECTED_ACTION = {
    "software_feature_defect": "auto_handle",
    "ios_version_downgrade": "auto_handle",
    "general_complaint_nonactionable": "auto_handle",
    "battery_drain": "auto_handle",
    "billing_account": "escalate",
    "non_english": "escalate",
    "out_of_scope": "escalate",
}

# Thread cleaning ------------------------------------------------------------
MENTION = r"@(\w+)"
LINK = r"https?://\S+"
DM = r"\bDMs?\b|\bDM'?d\b|direct message"
DM_LINKS = ["https://t.co/GDrqU22YpT", "https://t.co/GDrqU2kzhr"]
REDIRECT = (
    r"\bour [\w' ]{0,30}?(experts|specialists|engineers|team(?! up)\b"
    r"|support team|store team|sales support|billing support|application support)"
    r"|reach (out to )?(them|their team)|reach them (here|at)"
    r"|connect with our|get you (over )?to (our|the right)|get you in touch with"
    r"|pointed in the right direction|get you to the right place"
    r"|get help in \w+ here"
    r"|apple store|genius bar|make an appointment|give us a call|call us"
    r"|support\.apple\.com|getsupport|apple support (app|community)"
    r"|contact (your|the) (carrier|provider)"
)
GENERIC = (
    r"(thanks|thank you) for (reaching out|contacting|bringing this|letting us know|your patience)( to us)?"
    r"|we'?(re| are) (here|happy|glad|sorry) (to help|for you|to hear)?"
    r"|we'?d (like|love) to (help|know more)|we (can|want to|would like to) (help|assist)"
    r"|(please )?(send us a|join us in|shoot us a|could you )?\bDM\b( us)?( via the following link)?"
    r"|send us a direct message|we'?ll (assist|help|continue|go from there|take it from there)"
    r"|(and )?we'?ll (continue|go) (from )?there|let us know|from there|we'?ve got your back"
    r"|sorry (to hear|about|for)|we apologize|our apologies|happy to help|here to help"
)
INSTRUCT = (
    r"\bsettings\b|\btap\b|\bgo to\b|follow (the |these )?steps|try (this|that|these)"
    r"|restart|back up|turn (off|on)|toggle|reset|forget (those|the|this)"
    r"|update to|now available|workaround|make sure to|here'?s what you can do"
)
# Leading alternative stays anchored to the letter I followed by U+FE0F.
BUG = "I\uFE0F" r"|autocorrec|keyboard" "|letter [\"“'‘]?i\\b" r"|question mark|11\.1\.1"
INCIDENT_WINDOW = ("2017-11-02", "2017-11-12")
INCIDENT_TAG = "ios_11_1_bug"

# First-pass intent labels -----------------------------------------------------
LANG_REDIRECT = r"support via Twitter in English|preferred language|get help in \w+ here"
FOREIGN = (
    r"\b(que|n[ãa]o|para|meu|minha|mais|muito|com|voc[êe]|est[áa]|pra|porque|obrigad[oa]"
    r"|mis|muy|pero|gracias|hola|como|cuando|ahora|nada|hace"
    r"|ajuda|favor|ayuda|quiero|necesito|gostaria|preciso|aiuto|per favore"
    r"|ich|nicht|mein[e]?|bitte|und|ist|kein|habe|auch"
    r"|je|mon|les|une|pas|avec|c'est|tr[èe]s"
    r"|bir|çok|için|daha)\b"
)
ACCENTED = r"[áàâãäéèêëíìîïóòôõöúùûüñçşğı]"
ENGLISH_STOP = (
    r"\b(the|and|is|are|my|i|you|to|for|of|it|this|that|in|on|with|have|has|can|why|what"
    r"|not|but|so|me|your|was|get|just|do|does|all|been|when|how|now|new|please|help|fix)\b"
)
DOWNGRADE = (
    r"\brevert|downgrade|roll ?back|go(ing)? back to (the )?(ios ?10|old|previous|last)"
    r"|back to ios ?10|uninstall the (update|ios)|undo the update"
    r"|(return|restore) to (the )?(previous|old|ios ?10)|want ios ?10|bring back ios ?10"
    r"|ios ?10 back|(get|put|have) .{0,20}ios ?10|previous version of (ios|macos)"
)
BATTERY = r"\bbatter(y|ies)\b|battery drain|drain(s|ing|ed)?\b"
APPLE_PAY = r"apple ?pay"
BILLING = (
    r"itunes|apple music|subscri|purchas|charged|refund|payment|billing|invoice|receipt"
    r"|gift card|apple id|\baccount\b|\bpassword\b|\border(s|ed|ing)?\b|pre-?order|reservation"
    r"|\bpaid\b|\bpay\b|\bcredit\b|\bbought\b|\bbilled\b|icloud storage"
    r"|\bmy (apple )?id\b|locked out|can'?t (log|sign) ?in|two.?factor|verification code"
)
COMPONENT = (
    r"messages|imessage|notification|keyboard|autocorrect|camera|flashlight|wi-?fi|bluetooth"
    r"|siri|facetime|safari|\bmail\b|photos|airdrop|touch ?id|face ?id|screen|speaker"
    r"|microphone|alarm|calendar|maps|apple ?pay|airpods|earpods|headphone|apple watch"
    r"|macbook|imac|ipad|apple tv|touchpad|trackpad|app store|icloud|hotspot|volume"
    r"|brightness|charger|cable|lightning|\bapps?\b|earpiece|podcast|phone calls?|screen lock"
    r"|ringtone|contacts|wallpaper|\bmusic\b|\bvideo|\bsound\b|\bwatch\b|airplay|hey siri"
)
SYMPTOM = (
    r"crash|freez|not working|isn'?t working|won'?t|can'?t|cannot|broken|stuck|glitch|lag"
    r"|\bslow|disconnect|drop(s|ping|ped)?\b|fail|error|\bbug\b|unresponsive|black screen"
    r"|restart|reboot|delay|missing|disappear|no sound|distort|not letting|doesn'?t work"
    r"|will ?not|not (playing|recognis|recogniz|respond|open|load|charg|connect|work|avail)"
    r"|no (wifi|wi-?fi|sound|service|signal|volume)|too quiet|rotat|declin|locked|unable"
    r"|keeps? (turning|shutting|opening|rotating|freez|crash|dropp)|randomly|crackl"
    r"|do(esn|n)'?t work|didn'?t work|no longer works?|messed up|sticky|barely functions?"
)

# Relabel rules ------------------------------------------------------------------
THIN_MAX_WORDS = 6
FW_MIN_WORDS = 4
STRIP_TOKENS = r"https?://\S+|@BRAND|@USER|#\w+"
REAL_WORD = r"[A-Za-z']+"
DOWNGRADE_EVIDENCE = (
    r"\b(?:down\s?grad\w*"
    r"|revert\w*"
    r"|roll\s?back\w*"
    r"|go(?:ing)?\s+back"
    r"|(?:get|put|have|let|bring)\s+(?:\w+\s+){0,3}back\s+(?:to|on)"
    r"|back\s+(?:to|on)\s+(?:ios|os|mac\s?os|sierra|version|\d)"
    r"|(?:older|previous|earlier|old)\s+(?:\w+\s+){0,2}(?:version|versions|build|ios|os)"
    r"|re-?install\w*\s+(?:ios|os|the\s+(?:old|previous))"
    r"|un-?install\w*\s+(?:ios|the\s+update))"
)
# Letter ranges only: Arabic starts at U+0620 so the Arabic question mark U+061F is not evidence.
NON_LATIN = (
    r"[\u0620-\u06FF\u0750-\u077F"   # Arabic
    r"\u0400-\u04FF"                   # Cyrillic
    r"\u0370-\u03FF"                   # Greek
    r"\u0590-\u05FF"                   # Hebrew
    r"\u0900-\u097F"                   # Devanagari
    r"\u0E00-\u0E7F"                   # Thai
    r"\u3040-\u30FF\u4E00-\u9FFF"     # kana + CJK
    r"\uAC00-\uD7AF]"                  # Hangul
)
ENGLISH_FW = [
    "the", "you", "and", "of", "it", "my", "for", "with", "have", "this", "that",
    "not", "your", "are", "be", "do", "does", "can", "what", "why", "how", "but",
    "so", "if", "just", "all", "has", "dont", "cant", "im", "its", "there", "they",
    "will", "would", "get", "got", "been", "am", "we", "when", "now", "only",
    "please", "very", "from", "about", "after", "since", "still", "again", "more",
    "than", "because", "thanks", "thank", "know", "want", "need", "could",
    "should", "really", "every", "other", "much", "many", "even", "also", "both",
    "who", "which", "where", "into", "youre", "thats",
]
CURLY_APOSTROPHES = "‘’ʼ`"

# Out-of-scope kinds and blind spot ---------------------------------------------------
WARRANTY = (
    r"\b(warrant(y|ies)|apple\s?care|out of warranty|covered under|"
    r"trade[- ]?in|insurance|eligib(le|ility)|policy|terms and conditions|t&cs?|"
    r"how much (does|is|would)|what.{0,15}(price|cost)|price of|cost of)\b"
)
PHISH = (
    r"\b(scam|phish\w*|fake (email|text|message|website|site|link)|fraud\w*|"
    r"suspicious (email|text|message|link)|is this (real|legit|genuine|from you)|"
    r"did (you|apple) send|spam (email|text))\b"
)
PRAISE = (
    r"\b(thank you|thanks|love (my|the|this|you)|best phone|amazing|awesome|"
    r"well done|congrats|congratulations|treating my|happy with|great job|"
    r"you guys rock|appreciate it)\b"
)
META = (
    r"\b(280 characters?|140 characters?|character limit|characters we can|"
    r"this account|your twitter|twitter support|these paragraphs|"
    r"more characters)\b"
)
OOS_KINDS = [("warranty", WARRANTY), ("phishing", PHISH), ("praise", PRAISE), ("meta", META)]
BLIND = (
    r"\b(genius bar|appointment|apple store|in[- ]store|the store|repair(s|ed)?|"
    r"replac(e|ed|ement)|cracked|shattered|broken screen|screen (is )?(broke|crack)|"
    r"water damage|liquid damage|dropped my)\b"
)

# Drafting guards ---------------------------------------------------------------------
URL_OR_SHORT = r"https?://\S+|\bt\.co/\S+"
LINK_MARKER = "[link removed]"
OVERRIDES = [
    ("physical_or_hardware",
     r"\b(swell\w*|swollen|bulg\w*|overheat\w*|too hot|burn\w*|smok\w*|melt\w*|"
     r"spark\w*|crack\w*|shatter\w*|smash\w*|broken screen|screen (is )?(broke|crack)|"
     r"water damage|liquid damage|dropped (it|my|the)|went black|gone black|"
     r"(wont|won.t|not|isn.t|doesn.t) charg\w*|refus\w* to charge|"
     r"physical damage|bent|snapped)\b"),
    ("account_or_payment_action",
     r"\b(refund|charge(d)? me|charging me|unauthoris?zed charge|double charged|"
     r"cancel (my )?(subscription|order)|change (my )?(payment|card|billing)|"
     r"payment method|reset (my )?password|apple id password|hacked|"
     r"locked out|can.t log ?in|cannot log ?in|billed)\b"),
    ("phishing_or_scam",
     r"\b(scam|phish\w*|fake (email|text|message|website|site|link)|fraud\w*|"
     r"suspicious (email|text|message|link)|is this (real|legit|genuine|from you))\b"),
]
POLICY_ESCALATE_INTENTS = {"billing_account": "account_or_payment_action"}
BANNED_ERA_TERMS = ["Battery Health", "Optimised Battery Charging",
                    "Optimized Battery Charging", "Screen Time", "Find My",
                    "Dark Mode", "App Tracking Transparency"]
NARRATION = (
    r"\b(let'?s (try|draft|start)|based on the grounding|the grounding (material|text)|"
    r"i (will|would) draft|here'?s (a|the) (draft|reply)|as an ai|"
    r"since the grounding|steps to resolve.{0,20}not provide)"
)
MAX_CHARS = 280
SETTINGS_PATH = r"Settings\s*>\s*[A-Za-z][\w\s>&-]*"
VERSION = r"\b\d{1,2}\.\d(\.\d)?\b"
FEATURES = [
    "Battery Health", "Face ID", "Touch ID", "True Tone", "iCloud Drive", "Apple Pay",
    "Screen Time", "Control Center", "Low Power Mode", "AirDrop", "Handoff", "Night Shift",
    "Do Not Disturb", "Find My", "Keychain", "Safe Mode", "DFU", "Recovery Mode",
    "Optimised Battery Charging", "Optimized Battery Charging", "Background App Refresh",
]
TEMPLATES = {
    "battery_drain": (
        "Settings > Battery shows which apps have used the most battery - worth starting "
        "there. Turning Low Power Mode on helps, and so does turning off Background App "
        "Refresh for apps that don't need it. It's also worth checking Settings > General "
        "> Software Update for a pending update."
    ),
}
POLICY_FACTS = {
    "ios_version_downgrade": (
        "Downgrading is not supported once Apple stops signing the previous iOS build. "
        "Once signing ends there is no supported way to reinstall an older version, and "
        "the answer does not vary by customer or device."
    ),
}
NO_DRAFT = {
    "non_english": "escalate: language redirect (taxonomy section 6, always escalate)",
    "out_of_scope": "escalate: out of scope, no retrieval grounding permitted "
                    "(taxonomy section 7)",
}
NO_GROUNDING = "escalate: no grounding found"
ESCALATE_OVERRIDE = "escalate: safety/policy override"
NO_USABLE_REASON = ("no_usable_grounding: zero of top-5 retrieval candidates "
                    "passed gates G1-G4")

# Retrieval and sampling parameters -------------------------------------------------------
TAU = 0.20
TOP_K = 5
SAMPLE_PER_INTENT = 10
MAX_REPS = 3
NEAR_DUP = 0.95
RANDOM_PAIRS = 20000
TAU_PCTILE = 0.95
SAMPLE_N = 500
STRATUM_CAP = 0.15
RUBRIC_DIMS = ["relevance", "groundedness", "tone", "correctness"]
# ---------------------------------------------------------------------------
# END FIXED VALUES
# ---------------------------------------------------------------------------



def _folds() -> dict[str, str]:
    """Every Latin letter that decomposes into one ASCII letter and combining marks."""
    out = {}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base, marks = unicodedata.normalize("NFD", c)[0], unicodedata.normalize("NFD", c)[1:]
        if marks and base.isascii() and base.isalpha() and all(map(unicodedata.combining, marks)):
            out[c] = base
    return out


# Used to fold accented text before ASCII-only matching and for accent stripping.
ACCENT_FROM, ACCENT_TO = ("".join(x) for x in zip(*_folds().items()))
