"""These must equal the published ones for results to agree."""

# Character confusions, tried in this order.
CHARACTER_CONFUSIONS = (
    ("th", "t", "d"),
    ("ph", "f", "p"),
    ("sh", "s", "ch"),
    ("ch", "sh", "c"),
    ("v", "w", "b"),
    ("w", "v", "u"),
    ("z", "j", "s"),
    ("x", "ks", "z"),
    ("ck", "k", "c"),
    ("ee", "i", "e"),
    ("oo", "u", "ou"),
    ("aa", "a", "ah"),
    ("ii", "i", "ee"),
    ("uu", "u", "oo"),
    ("kh", "k", "kha"),
    ("gh", "g", "gha"),
    ("ng", "n", "ngg"),
    ("ya", "ia", "a"),
    ("wa", "va", "a"),
)

# Letters for the random overwrite when no confusion applies.
OVERWRITE_LETTERS = "aeiouklmnrst"

# Short function words, Hindi then English.
FUNCTION_WORDS = (
    "ne ko ka ki ke hai hain tha thi the se par mein me ho hoga "
    "is are was a an of in on at to"
).split()

# Hesitation tokens.
FILLERS = "umm uh hmm err aah arre".split()

# Spelling variants of transliterated words (repeats carry weight).
SPELLING_VARIANTS = {
    "kya": ["kiya", "kyaa", "kia"],
    "nahi": ["nhi", "nahin", "naheen", "nai"],
    "bhi": ["bhe", "bi", "bii"],
    "hoga": ["hoga", "hoga", "hogaa"],
    "yaar": ["yar", "yaar", "yar"],
    "abhi": ["abhi", "abi", "abhii"],
    "acha": ["accha", "achaa", "acha"],
    "ek": ["ak", "ek", "eik"],
}

# Share of tokens hit per level, and the mix of token errors.
TOKEN_RATES = {"low": 0.10, "medium": 0.20, "high": 0.35}
TOKEN_ERROR_MIX = {"char_sub": 0.30, "split": 0.15, "delete": 0.20, "filler": 0.10, "translit": 0.25}

# Share of characters hit per level in the character channel.
CHARACTER_RATES = {"low": 0.05, "medium": 0.10, "high": 0.20}

# Condition codes and their reporting order.
LEVEL_CODES = {"clean": 0, "low": 1, "medium": 2, "high": 3}

# Alphabet of the character encoder; PAD and UNK follow it.
ENCODER_ALPHABET = (
    " abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    ".,!?@#&'-_:/\"\n\t"
)
ENCODER_LENGTH = 300

# Double-encoded sequences and their repair; U+FFFD is dropped.
MOJIBAKE = (
    ("â€”", "—"),
    ("â†’", "→"),
    ("â\u0080\u0094", "—"),
    ("â\u0086\u0092", "→"),
    ("\ufffd", ""),
)
# First characters that betray double encoding.
MOJIBAKE_STARTS = "âÃÎ\ufffd"

# ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Separator between context parts, split shares, seeds and blends.
CONTEXT_SEPARATOR = " [SEP] "
SEED = 42
TEST_SHARE = 0.15
VALIDATION_SHARE = 0.15
TRAIN_SHARE = 0.70
CONTEXT_WEIGHT = 0.4
TEXT_WEIGHT = 0.6
TEMPERATURE = 0.15
ZERO_OVERLAP = 0.001
