"""Default parameter tables. Operators take them as arguments; nothing reads them behind a caller's back."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

# Enumerations of the data model.
RISKS = {"safe": 0, "mature": 1, "restricted": 2}
ACTIONS = {"play": 0, "swap": 1, "skip": 2, "mute": 3, "blur": 4}
RESTRICTIVENESS = {"skip": 5, "swap": 4, "blur": 3, "mute": 2, "play": 1}
CODECS = {0x1: "H.264", 0x2: "H.265", 0x3: "AV1", 0x4: "VP9", 0x100: "AAC", 0x101: "Opus", 0x102: "AC-3", 0x103: "EAC-3"}
FLAGS = {"compressed": 0, "chapters": 1, "subtitles": 2, "seekable": 3}
PACKETS = {"video": 1, "audio": 2, "subtitle": 3}

# Thresholds.
LIVE_THRESHOLD, CARTOON_THRESHOLD, SECOND_CHECKER, SILENT = 0.6, 0.8, 0.3, 0.7
TRANSCRIPT_CHARS = 2000
CHILD_UNTIL, TEEN_UNTIL = 13, 18

# Words that make an audio bucket a "language" detection.
PROFANITY = (
    "fuck", "shit", "damn", "hell", "bastard", "asshole", "bitch", "cunt", "pussy", "dick", "cock", "nigger", "nigga", "faggot", "whore", "slut",
    "retard",
)

# Caption keywords by tag; a keyword that stands n times has weight n.
CAPTION_KEYWORDS = {
    "nudity": (
        "nude", "naked", "naked", "nude", "naked", "nude", "naked", "breast", "boob", "tit", "tits", "nipple", "genital", "penis", "vagina", "ass",
        "butt", "buttocks", "anal", "sexual", "sex", "nude", "naked", "exposed", "topless", "bottomless", "underwear", "lingerie", "bra", "panty",
        "thong", "masturbat", "orgasm", "ejaculat", "cum", "lubricat", "intimate", "seductiv", "sensual", "erotic", "porn", "strip", "burlesque",
        "nude art", "nude model",
    ),
    "violence": (
        "fight", "hit", "punch", "kick", "slap", "beat", "assault", "attack", "weapon", "gun", "knife", "sword", "stab", "shoot", "bullet", "bomb",
        "explode", "destroy", "crash", "accident", "war", "battle", "combat", "military", "soldier", "army", "hurt", "injure", "wound", "blood",
        "bleed", "torture", "abuse", "domestic violence", "mugging", "robbery", "violent", "aggressive", "brutal", "savage",
    ),
    "gore": (
        "gore", "gory", "blood", "bloody", "bleed", "wound", "injury", "mutilat", "dismember", "corpse", "dead body", "skull", "bone", "viscera",
        "organ", "flesh", "skinned", "flayed", "graphically", "gruesome", "macabre", "horrifying", "execute", "execution", "behead", "decapitat",
        "torture", "mutilation", "cannibal", "flesh wound",
    ),
    "fear": (
        "scary", "frightening", "terrifying", "horror", "creepy", "eerie", "spooky", "haunted", "ghost", "demon", "monster", "zombie", "vampire",
        "werewolf", "supernatural", "threatening", "menacing", "danger", "peril", "suspense", "tension", "thriller", "chase", "pursuit",
        "jump scare", "nightmare", "nightmarish", "disturbing", "shocking", "alarming", "panic", "terror", "fear", "anxiety", "anxious", "nervous",
        "tense",
    ),
    "language": (
        "fuck", "shit", "damn", "hell", "bastard", "asshole", "bitch", "cunt", "pussy", "dick", "cock", "nigger", "nigga", "faggot", "whore",
        "slut", "retard", "motherfucker", "bullshit", "crap", "piss", "screw", "suck", "god damn", "jesus christ", "profanity", "swear", "cursing",
        "vulgar", "obscene", "rude", "inappropriate", "offensive", "insult",
    ),
}
#: How much weight of keywords a tag needs; others need 2.
KEYWORD_THRESHOLD = {"language": 1}

# Topic names, in the order in which a free-text answer is searched for them.
TOPICS = (
    "profanity", "religion_christianity", "religion_general", "politics", "feminism", "masculinity", "drugs", "alcohol", "smoking", "sex_education",
    "lgbtq", "racism", "mental_health", "death_grief", "war_military", "crime", "violence_domestic", "self_harm",
)

# The built-in viewer profiles.
PROFILES = {
    "child": {"nudity": "swap", "violence": "blur", "language": "mute", "gore": "skip", "fear": "skip", "profanity": "skip", "drugs": "skip", "alcohol": "skip"},
    "teen_m": {"nudity": "swap", "gore": "skip", "profanity": "mute"},
    "teen_f": {"nudity": "swap", "violence": "blur", "profanity": "mute"},
    "adult": {},
}
FALLBACK_ORDER = ("adult", "teen_m", "teen_f", "teen", "child")


def keyword_weights(table: Mapping[str, Sequence[str]] = CAPTION_KEYWORDS) -> dict[str, dict[str, int]]:
    """How often each keyword stands in each tag's list."""
    return {tag: dict(Counter(words)) for tag, words in table.items()}
