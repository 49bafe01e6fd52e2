"""Phrases, labels and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First words that the endings don't explain.
IRREGULAR = {
    "is": "be", "are": "be", "was": "be", "were": "be",
    "has": "have", "had": "have",
    "moves": "move", "moving": "move", "moved": "move",
}


def squeeze(c: Column) -> Column:
    """White space runs (Unicode ones too) to single spaces, none outside."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def raw_phrase(c: Column) -> Column:
    return squeeze(F.translate(F.lower(F.coalesce(c, F.lit(""))), "_-", "  "))


def stem(t: Column) -> Column:
    """Irregular forms, then -ing, -ed and -s where enough letters stay."""
    table = F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv])
    n = F.length(t)
    cut = lambda k: t.substr(F.lit(1), n - k)
    by_ending = F.when((n > 4) & t.endswith("ing"), cut(3)).when((n > 3) & t.endswith("ed"), cut(2)).when((n > 3) & t.endswith("s"), cut(1)).otherwise(t)
    return F.coalesce(F.try_element_at(table, t), by_ending)


def canonical(c: Column, drop_lone_be: bool = False) -> Column:
    """The phrase with its first word stemmed; a leading 'be' goes if more words follow (or always)."""
    words = F.split(raw_phrase(c), " ")
    out = F.concat(F.array(stem(words[0])), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))))
    more = F.size(out) > (0 if drop_lone_be else 1)
    return F.array_join(F.when((out[0] == "be") & more, F.slice(out, 2, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(out), " ")


def merge_text(c: Column) -> Column:
    """Letters and digits (of any script) in lower case, single spaces between."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))



#: Families of actions in order; the first with a pattern in the text, or in the text without gaps, names it.
FAMILIES = {
    "watch": [r"\bwatch(?:ing)?\b", r"\blook(?:ing)?\s*at\b", r"lookat"],
    "listen to": [r"\blisten(?:ing)?\s*to\b"],
    "talk to": [r"\btalk(?:ing)?\s*to\b", r"\bspeak(?:ing)?\s*to\b", r"\bchat(?:ting)?\s*with\b"],
    "carry hold": [r"\bcarry(?:ing)?\b", r"\bhold(?:ing)?\b"],
    "touch": [r"\btouch(?:ing)?\b"],
    "push": [r"\bpush(?:ing)?\b"],
    "pull": [r"\bpull(?:ing)?\b"],
    "point to": [r"\bpoint(?:ing)?\s*(?:to|at)\b"],
    "hit": [r"\bhit(?:ting)?\b", r"\bstrike\b"],
    "fight": [r"\bfight(?:ing)?\b"],
    "give": [r"\bgive\b", r"\bgiving\b", r"\bserve\b"],
    "hand": [r"\bhand\b"],
    "grab": [r"\bgrab(?:bing)?\b"],
    "hand shake": [r"\bhand\s*shake\b", r"\bshake\s*hands?\b"],
    "hug": [r"\bhug(?:ging)?\b"],
    "kiss": [r"\bkiss(?:ing)?\b"],
    "lift": [r"\blift(?:ing)?\b", r"\bpick\s*up\b"],
    "sing to": [r"\bsing(?:ing)?\s*to\b"],
    "take from": [r"\btak(?:e|ing)\s+.*\s+from\b"],
    "ride": [r"\bride\b", r"\briding\b"],
    "take a photo": [r"\btake\b.*\bphoto\b", r"\bphotograph\b"],
    "work on": [r"\bwork(?:ing)?\s*on\b"],
    "use": [r"\buse\b", r"\busing\b"],
    "answer phone": [r"\banswer(?:ing)?\s*phone\b"],
}


def family(c: Column) -> Column:
    text = merge_text(c)
    compact = F.regexp_replace(text, "[^a-z0-9]+", "")
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, patterns in FAMILIES.items():
        either = "|".join(patterns)
        out = out.when(text.rlike(either) | compact.rlike(either), name)
    return out


def merge_key(c: Column) -> Column:
    return F.coalesce(family(c), merge_text(c))


def trim_edges(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "^[\\s\"'`\\[\\](){}.,;:!?]+", ""), "[\\s\"'`\\[\\](){}.,;:!?]+$", "")


def unique_ignoring_case(a: Column) -> Column:
    """First spelling of each text, in order."""
    low = F.transform(a, lambda x: F.lower(x))
    return F.transform(F.filter(F.transform(a, lambda x, i: F.struct(x.alias("x"), (F.array_position(low, F.lower(x)) == i + 1).alias("first"))), lambda s: s["first"]), lambda s: s["x"])


def as_list(c: Column) -> Column:
    """Comma list to unique trimmed entries."""
    return unique_ignoring_case(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: squeeze(x)), lambda x: x != ""))


def strip_uncertain(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)\s*\(uncertain\)\s*$", "")


def safe_int(c: Column, default: int = 0) -> Column:
    """Whole numbers as text; anything else is the default."""
    return F.coalesce(F.when(F.trim(c).rlike(r"^[+-]?[0-9]+$"), F.trim(c).try_cast("long")), F.lit(default).cast("long"))


def class_of_node(node_id: Column) -> Column:
    return F.regexp_replace(node_id, r"_[0-9]+$", "")


def number_of_node(node_id: Column) -> Column:
    return F.regexp_extract(node_id, r"([0-9]+)$", 1).try_cast("int")


def humanise(node_id: Column) -> Column:
    return squeeze(F.translate(class_of_node(node_id), "_-", "  "))


def definite(c: Column) -> Column:
    return F.when(F.lower(c).rlike(r"^(the|a|an|this|that|his|her|their)\b"), c).otherwise(F.concat(F.lit("the "), c))


def video_name(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"\.mp4$", "")


def clock_seconds(c: Column) -> Column:
    """MM:SS or HH:MM:SS."""
    p = F.transform(F.split(c, ":"), lambda x: x.try_cast("double"))
    return F.when(F.size(p) == 2, p[0] * 60 + p[1]).when(F.size(p) == 3, p[0] * 3600 + p[1] * 60 + p[2])


def doc_hash63(c: Column) -> Column:
    """First eight bytes of md5, little-endian, without the sign bit."""
    h = F.md5(c)
    swapped = F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)])
    low = F.conv(F.substring(swapped, 2, 15), 16, 10).cast("long")
    high = F.conv(F.substring(swapped, 1, 1), 16, 10).cast("int").bitwiseAND(F.lit(7)).cast("long")
    return F.shiftleft(high, 60).bitwiseOR(low)


def split_slice(spec: str) -> tuple[str, int | None, int | None]:
    """'train[a:b]' -> (name, a, b)."""
    import re

    m = re.fullmatch(r"(\w+)(?:\[(\d*):(\d*)\])?", spec)
    if not m:
        raise ValueError(f"not a split: {spec}")
    return m[1], int(m[2]) if m[2] else None, int(m[3]) if m[3] else None


_NUMBERS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine ten".split())}


#: Contractions of answers as they are written without some of their apostrophes.
CONTRACTIONS = {
    "aint": "ain't", "arent": "aren't", "cant": "can't", "couldve": "could've", "couldnt": "couldn't",
    "couldn'tve": "couldn't've", "couldnt've": "couldn't've", "didnt": "didn't", "doesnt": "doesn't", "dont": "don't",
    "hadnt": "hadn't", "hadnt've": "hadn't've", "hadn'tve": "hadn't've", "hasnt": "hasn't", "havent": "haven't",
    "hed": "he'd", "hed've": "he'd've", "he'dve": "he'd've", "hes": "he's", "howd": "how'd", "howll": "how'll",
    "hows": "how's", "Id've": "I'd've", "I'dve": "I'd've", "Im": "I'm", "Ive": "I've", "isnt": "isn't", "itd": "it'd",
    "itd've": "it'd've", "it'dve": "it'd've", "itll": "it'll", "let's": "let's", "maam": "ma'am", "mightnt": "mightn't",
    "mightnt've": "mightn't've", "mightn'tve": "mightn't've", "mightve": "might've", "mustnt": "mustn't",
    "mustve": "must've", "neednt": "needn't", "notve": "not've", "oclock": "o'clock", "oughtnt": "oughtn't",
    "ow's'at": "'ow's'at", "'ows'at": "'ow's'at", "'ow'sat": "'ow's'at", "shant": "shan't", "shed've": "she'd've",
    "she'dve": "she'd've", "she's": "she's", "shouldve": "should've", "shouldnt": "shouldn't",
    "shouldnt've": "shouldn't've", "shouldn'tve": "shouldn't've", "somebody'd": "somebodyd",
    "somebodyd've": "somebody'd've", "somebody'dve": "somebody'd've", "somebodyll": "somebody'll",
    "somebodys": "somebody's", "someoned": "someone'd", "someoned've": "someone'd've", "someone'dve": "someone'd've",
    "someonell": "someone'll", "someones": "someone's", "somethingd": "something'd", "somethingd've": "something'd've",
    "something'dve": "something'd've", "somethingll": "something'll", "thats": "that's", "thered": "there'd",
    "thered've": "there'd've", "there'dve": "there'd've", "therere": "there're", "theres": "there's", "theyd": "they'd",
    "theyd've": "they'd've", "they'dve": "they'd've", "theyll": "they'll", "theyre": "they're", "theyve": "they've",
    "twas": "'twas", "wasnt": "wasn't", "wed've": "we'd've", "we'dve": "we'd've", "weve": "we've", "werent": "weren't",
    "whatll": "what'll", "whatre": "what're", "whats": "what's", "whatve": "what've", "whens": "when's",
    "whered": "where'd", "wheres": "where's", "whereve": "where've", "whod": "who'd", "whod've": "who'd've",
    "who'dve": "who'd've", "wholl": "who'll", "whos": "who's", "whove": "who've", "whyll": "why'll", "whyre": "why're",
    "whys": "why's", "wont": "won't", "wouldve": "would've", "wouldnt": "wouldn't", "wouldnt've": "wouldn't've",
    "wouldn'tve": "wouldn't've", "yall": "y'all", "yall'll": "y'all'll", "y'allll": "y'all'll", "yall'd've": "y'all'd've",
    "y'alld've": "y'all'd've", "y'all'dve": "y'all'd've", "youd": "you'd", "youd've": "you'd've", "you'dve": "you'd've",
    "youll": "you'll", "youre": "you're", "youve": "you've",
}


def vqa_answer(c: Column) -> Column:
    """Lower case, no articles or punctuation, number words as digits, contractions with their apostrophes."""
    table = F.create_map(*[F.lit(x) for kv in (_NUMBERS | CONTRACTIONS).items() for x in kv])
    clean = F.regexp_replace(F.regexp_replace(F.lower(c), r"(?<=[0-9]),(?=[0-9])", ""), r"[^a-z0-9 .:']+|\.(?![0-9])", " ")
    words = F.filter(F.split(squeeze(clean), " "), lambda w: ~w.isin("a", "an", "the"))
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")
