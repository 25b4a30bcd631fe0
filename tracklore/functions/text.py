"""Column expressions on labels, tokens and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracklore.functions.vectors import let

# fixed values
ALIASES = {"spelling": "fs", "finger_spelling": "fs", "space": " ", "nothing": "<none>", "del": "<delete>"}
NEGATIONS = ("not", "n't", "no", "never", "none", "cannot", "cant", "wont", "dont", "didnt", "isnt",
             "hardly", "barely", "scarcely", "nothing", "nowhere", "nobody")
QUESTION_STARTERS = ("what", "where", "when", "who", "why", "how", "do", "does", "did", "can", "could",
                     "is", "are", "am", "was", "were", "will", "would", "should", "may", "might")
CONVERSATION_WORDS = {
    "hello": 5000000000, "hi": 4000000000, "name": 4500000000, "where": 4000000000, "hospital": 2000000000,
    "bathroom": 1500000000, "toilet": 1000000000, "thank": 3500000000, "you": 6000000000, "very": 4000000000,
    "much": 3500000000, "need": 3000000000, "help": 4000000000, "now": 3500000000, "can": 4500000000, "call": 3000000000,
    "doctor": 2500000000, "nurse": 1500000000, "please": 3000000000, "wait": 2500000000, "for": 4000000000,
    "me": 4500000000, "love": 3500000000, "like": 3500000000, "good": 4000000000, "morning": 2500000000,
    "night": 2500000000, "understand": 2000000000, "see": 3500000000, "later": 2500000000, "nice": 3000000000,
    "meet": 3000000000, "fine": 2500000000, "how": 4000000000, "what": 4500000000, "why": 3500000000, "who": 3500000000,
    "when": 3500000000, "is": 6000000000, "the": 8000000000, "a": 7000000000, "an": 5000000000, "my": 5000000000,
    "your": 4500000000,
}
CONVERSATION_PAIRS = (
    "hello my", "my name", "name is", "where is", "is the", "the hospital", "the bathroom", "the doctor", "thank you",
    "you very", "very much", "i need", "need help", "help now", "can you", "you call", "call a", "a doctor", "please wait",
    "wait for", "for me", "i love", "love you", "nice to", "to meet", "meet you", "do not", "not understand",
)
I_FORMS = ("i", "i'm", "i'll", "i'd", "i've")
PLACEHOLDERS = ("", "unknown", "none")
PAD, BOS, EOS, UNK, OFFSET = 0, 1, 2, 3, 4
SPACE_ID, LETTER_ID, DIGIT_ID = 4, 5, 31


def _c(v: Column | str) -> Column:
    return F.col(v) if isinstance(v, str) else v


def squeeze(v: Column) -> Column:
    return F.trim(F.regexp_replace(v, r"[ \t\n\r]+", " "))


def tokens(v: Column | str) -> Column:
    return F.filter(F.split(_c(v), r"[ \t\n\r]+"), lambda w: w != "")


def normalize_gloss(v: Column | str) -> Column:
    clean = squeeze(F.translate(F.lower(_c(v)), "_-", "  "))
    out = clean
    for k, a in ALIASES.items():
        out = F.when(clean == k, a).otherwise(out)
    return F.when(_c(v).isNull() | (clean == ""), "<none>").otherwise(out)


def clean_spelled_label(processed: Column | str, raw: Column | str) -> Column:
    """Annotator marks removed: '#' comments, '*' corrections, '2:', '?', '!'."""
    p = F.trim(_c(processed))
    s = F.when(p.isNull() | (p == ""), F.trim(F.coalesce(_c(raw), F.lit("")))).otherwise(p)
    t = F.trim(F.substring_index(F.trim(F.substring_index(s, "#", 1)), "*", -1))
    t = F.when(t.startswith("2:"), F.trim(F.substr(t, F.lit(3)))).otherwise(t)
    t = F.translate(F.trim(F.regexp_replace(t, r"\?+$", "")), "!", " ")
    return F.when(s == "", "").otherwise(normalize_gloss(t))


def english_tokens(v: Column | str) -> Column:
    """Lower-case words with punctuation split off."""
    spaced = F.regexp_replace(F.lower(F.trim(_c(v))), r"([.?!,;:—\-()\[\]\"'])", " $1 ")
    return tokens(spaced)


def char_ids(v: Column | str) -> Column:
    """BOS, one id per kept character (space 4, a-z from 5, 0-9 from 31), EOS."""
    kept = F.regexp_replace(F.replace(F.lower(_c(v)), F.lit("<sp>"), F.lit(" ")), r"[^a-z0-9 ]", "")
    chars = F.filter(F.split(kept, ""), lambda c: c != "")
    ids = F.transform(chars, lambda c: F.when(c == " ", SPACE_ID).when(
        c.between("a", "z"), F.ascii(c) - 97 + LETTER_ID).otherwise(F.ascii(c) - 48 + DIGIT_ID))
    return F.concat(F.array(F.lit(BOS)), ids, F.array(F.lit(EOS)))


def pad_keep_last(ids: Column | str, n: int, pad: int = PAD) -> Column:
    """Exactly n ids; a cut sequence keeps its last id."""
    a = _c(ids)
    cut = F.concat(F.slice(a, 1, n - 1), F.slice(a, -1, 1))
    return F.when(F.size(a) > n, cut).otherwise(
        F.concat(a, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), n - F.size(a)))))


def has_negation(v: Column | str) -> Column:
    return F.arrays_overlap(tokens(F.lower(_c(v))), F.array(*[F.lit(w) for w in NEGATIONS]))


def route_source(v: Column | str) -> Column:
    s = F.lower(_c(v))
    return (F.when(s.contains("chicago"), 1).when(s.contains("how2sign"), 2).when(s.contains("citizen"), 3)
            .when(s.contains("wlasl"), 4).when(s.contains("alphabet"), 5)
            .when(s.contains("number") | s.contains("digit"), 6).otherwise(0))


def route_task(task: Column | str, source: Column | str) -> Column:
    """0 isolated, 1 fingerspelling, 2 sentence."""
    s, t = F.lower(_c(source)), _c(task)
    return (F.when((t == "fingerspelling_sequence") | s.contains("chicago"), 1)
            .when((t == "sentence_level") | s.startswith("how2sign"), 2).otherwise(0))


def natural_key(v: Column | str) -> Column:
    """Sort key in which digit runs of any length compare as numbers: each is led by its length, five digits wide."""
    runs = F.regexp_extract_all(F.lower(_c(v)), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(
        r.rlike("^[0-9]"), let(F.ltrim(r, F.lit("0")), lambda d: F.concat(F.lpad(F.length(d).cast("string"), 5, "0"), d))).otherwise(r)), "")


def hash_fraction(v: Column | str) -> Column:
    return F.conv(F.substring(F.md5(_c(v).cast("string")), 1, 8), 16, 10).cast("bigint") / 4294967295.0


def split_of(v: Column | str, existing: Column | None = None) -> Column:
    h = hash_fraction(v)
    computed = F.when(h < 0.8, "train").when(h < 0.9, "val").otherwise("test")
    if existing is None:
        return computed
    return F.when(existing.isin("train", "val", "test"), existing).otherwise(computed)


def md5_mod10(v: Column | str) -> Column:
    """The whole md5 as a number modulo ten; two halves, as 2**64 mod 10 is 6."""
    m = F.md5(_c(v).cast("string"))
    half = lambda a: F.conv(F.substring(m, a, 16), 16, 10).cast("decimal(20,0)") % 10
    return ((half(1) * 6 + half(17)) % 10).cast("int")


def unit(*parts: Column) -> Column:
    """Reproducible number in [0, 1) from a key, a seed and what else is given."""
    h = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint") / float(1 << 52)


def mask_tokens(ids: Column | str, key: Column, seed: int, rate: float = 0.15) -> Column:
    """Regular ids become UNK at ``rate`` when more than three of them exist."""
    a = _c(ids)
    special = lambda x: x.isin(PAD, BOS, EOS)
    masked = F.transform(a, lambda x, i: F.when(
        ~special(x) & (unit(key, i, F.lit(seed)) < rate), UNK).otherwise(x))
    return F.when(F.size(F.filter(a, lambda x: ~special(x))) > 3, masked).otherwise(a)


def corrupt_tokens(ids: Column | str, key: Column, seed: int, mask: float = 0.15,
                   drop: float = 0.10, shuffle: float = 0.10) -> Column:
    """Seeded span shuffle, deletion and masking; up to three ids stay as they are."""
    a = _c(ids)
    n = F.size(a)
    span = F.lit(2) + F.floor(unit(key, F.lit(seed), F.lit("span")) * 3).cast("int")
    start = F.floor(unit(key, F.lit(seed), F.lit("at")) * (n - span + 1)).cast("int") + 1
    mixed = F.transform(F.array_sort(F.transform(F.slice(a, start, span), lambda x, i: F.struct(
        unit(key, i, F.lit(seed), F.lit("mix")).alias("u"), x.alias("x")))), lambda s: s["x"])
    rest = F.slice(a, start + span, F.greatest(F.lit(0), n))
    shuffled = F.when(
        (n > span) & (unit(key, F.lit(seed), F.lit("go")) < shuffle),
        F.concat(F.slice(a, F.lit(1), start - 1), mixed, rest)).otherwise(a)
    kept = F.filter(shuffled, lambda x, i: unit(key, i, F.lit(seed), F.lit("drop")) >= drop)
    out = F.transform(kept, lambda x, i: F.when(
        unit(key, i, F.lit(seed), F.lit("mask")) < mask, UNK).otherwise(x))
    return F.when((n <= 3) | (F.size(out) == 0), a).otherwise(out)


def client_ip(forwarded: Column | str, real: Column | str, remote: Column | str) -> Column:
    """First forwarded address, else the real-ip header, else the connection."""
    part = r"(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    valid = lambda v: v.rlike(rf"^{part}(\.{part}){{3}}$") | v.rlike(r"^[0-9a-fA-F:]*:[0-9a-fA-F:]+$")
    first = F.trim(F.substring_index(_c(forwarded), ",", 1))
    return F.coalesce(F.when(valid(first), first), F.when(valid(_c(real)), _c(real)), _c(remote), F.lit("Unknown"))


def floats_to_text(v: Column | str) -> Column:
    return F.array_join(F.transform(_c(v), lambda x: x.cast("string")), ",")


def text_to_floats(v: Column | str) -> Column:
    return F.split(_c(v), ",").cast("array<double>")


def sentence_case(words: Column | str, names: Column) -> Column:
    """Capital at the start, for names and for I-forms; '?' after question starters."""
    w = F.filter(_c(words), lambda x: F.trim(x) != "")
    cap = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))
    done = F.transform(w, lambda x, i: F.when((i == 0) | F.array_contains(names, F.lower(x)), cap(x)).when(
        F.lower(x).isin(*I_FORMS), F.concat(F.lit("I"), F.substr(x, F.lit(2)))).otherwise(F.lower(x)))
    text = F.array_join(done, " ")
    asks = F.lower(F.get(w, F.lit(0))).isin(*QUESTION_STARTERS)
    end = F.when(text.rlike("[.?!]$"), "").when(asks, "?").otherwise(".")
    return F.when(F.size(w) == 0, "").otherwise(F.concat(text, end))
