"""Text to tokens, as Spark SQL expressions (no Python in the hot path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop-word list shipped with Apache Spark ML
# (StopWordsRemover.loadDefaultStopWords("english")), 181 words.  The topic
# tokenizer takes any list; this is the default.
ENGLISH_STOP_WORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him
his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be
been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through
during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more
most other some such no nor not only own same so than too very s t can will
just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd
she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't
won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's
how's let's ought that's there's what's when's where's who's why's would
""".split())

# Code points that Python's Unicode-aware ``\s`` treats as white space; Java
# and RE2 ``\s`` only know the ASCII ones, so the class is spelled out to keep
# the topic tokenizer's "delete everything but a-z and white space" rule.
_PY_SPACE_RANGES = [(0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0),
                    (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029),
                    (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]

TOPIC_MIN_LEN = 3   # tokens of length <= 2 are dropped
TOPIC_MAX_LEN = 15  # longer tokens are dropped, not cut


def _space_class(dialect: str) -> str:
    out = []
    for lo, hi in _PY_SPACE_RANGES:
        if dialect == "duckdb":
            a, b = f"\\x{{{lo:04x}}}", f"\\x{{{hi:04x}}}"
        else:
            a, b = f"\\u{lo:04x}", f"\\u{hi:04x}"
        out.append(a if lo == hi else f"{a}-{b}")
    return "".join(out)


def topic_strip_pattern(dialect: str = "spark") -> str:
    """Regex of characters deleted before topic tokenisation."""
    return f"[^a-z{_space_class(dialect)}]"


def topic_split_pattern(dialect: str = "spark") -> str:
    return f"[{_space_class(dialect)}]+"


def _extra_spaces() -> str:
    """Python white space that Java's ASCII ``\\s`` does not know."""
    java = {0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20}
    return "".join(chr(c) for lo, hi in _PY_SPACE_RANGES for c in range(lo, hi + 1) if c not in java)


def topic_tokens(text, stop_words=ENGLISH_STOP_WORDS) -> Column:
    """Lower-case, delete non a-z letters (accented letters vanish, they are
    not folded), split on white space, keep tokens of 3..15 letters that are
    not stop words.  Duplicates and order are kept.

    The few Unicode spaces Java's ``\\s`` lacks are first mapped to ' ' by
    ``translate`` (a char map), so the deletion can use the plain ASCII class —
    an order of magnitude faster in the JVM than spelling the class out."""
    text = F.col(text) if isinstance(text, str) else text
    extra = _extra_spaces()
    spaced = F.translate(F.lower(text.cast("string")), extra, " " * len(extra))
    cleaned = F.regexp_replace(spaced, r"[^a-z\s]", "")
    toks = F.split(cleaned, r"\s+")
    stops = list(stop_words or ())

    def keep(t):
        ok = (F.length(t) >= TOPIC_MIN_LEN) & (F.length(t) <= TOPIC_MAX_LEN)
        return ok & ~t.isin(*stops) if stops else ok  # IN over many literals becomes a hash set
    return F.filter(toks, keep)


WORD_SPLIT = r"[^\p{L}\p{N}]+"


def word_tokens(text) -> Column:
    """Lower-cased runs of letters or digits (any script) — input of the hashed encoder."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), WORD_SPLIT),
                    lambda t: F.length(t) > 0)


def stop_words_sql(stop_words=ENGLISH_STOP_WORDS) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in stop_words) + "]"
