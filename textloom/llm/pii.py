"""Personal data: base patterns, and boosted trees over what high-recall generators propose besides.

Everything is DataFrame expressions. A kind's matches and their places come from the pieces between matches (split)
and the matches themselves (regexp_extract_all). Each proposal's format and context become bits of one number. The
trees are boosted from seeded synthetic texts (a bounded sample, TRAINING texts): personal data in base form and in forms
that the base patterns miss, and look-alikes (versions, prices, order and part numbers, prose). The texts go through the
same expressions; a proposal is right if it is exactly a written span. Four folds train, the fifth calibrates a
threshold for each kind. The trees are then a SQL expression over the bits, in one pass over the documents.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, written so that Java neither recurses nor scans a run twice: a match can't start inside
#: a run whose start failed, and possessive groups are loops.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A cheap test that a text without a match of the kind (base or proposed) nearly always fails.
HINT = {
    "email": r"@|[\[(]at[\])]| at [A-Za-z0-9-]+ dot ", "ip": r"[0-9](?:\.| ?[\[(](?:\.|dot)[\])] ?)[0-9]", "card": r"[0-9](?:[ -]?[0-9]){11}|(?:[0-9]{4}[./_] ?){3}[0-9]{4}",
    "phone": r"\+[0-9]|[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|(?<![0-9])00[0-9]{1,3}[ .-]",
}
#: High-recall generators by kind, alternatives of one pattern where they don't overlap; what they propose may overlap
#: base spans and each other.
PROPOSED = {
    "email": ["|".join([
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]{1,63}){1,8}",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} at [A-Za-z0-9-]{1,63}(?: dot [A-Za-z0-9-]{1,63}){1,4}",
    ])],
    "ip": ["|".join([r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])", r"(?<![0-9.])[0-9]{1,3}(?: ?[\[(](?:\.|dot)[\])] ?[0-9]{1,3}){3}(?![0-9])"])],
    "card": ["|".join([r"(?<![0-9])[0-9]{12,19}(?![0-9])", r"(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}(?![0-9])", r"(?<![0-9])[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?![0-9])", r"(?<![0-9])[0-9]{4}(?:[./_] ?[0-9]{4}){3}(?![0-9])"])],
    "phone": [r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|\+[0-9]{9,15}(?![0-9])", r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9])00[0-9]{1,3}(?:[ .-][0-9]{2,5}){2,5}(?![0-9])"],
}
#: Words in the AROUND characters before a proposal that speak for a kind, or for another number.
AROUND = 24
CUES = {
    "mail_word": r"(?i)\b(?:e?-?mail|contact|write|reach|inbox|correo|schreib)", "phone_word": r"(?i)\b(?:tel|phone|call|fax|mobile|cell|whatsapp|sms|dial)",
    "card_word": r"(?i)\b(?:card|visa|master|amex|credit|debit|pay|charge)", "net_word": r"(?i)\b(?:ip|host|server|addr|ping|login|client|from|node)\b",
    "number_word": r"(?i)(?:\b(?:version|section|chapter|order|invoice|ref|isbn|no|ticket|sku|build|release|figure|part|tracking|serial|item|id|price|qty)\b[.:#]?|#|\bv) ?$",
}
#: Bits of a proposal, in order.
BITS = ("email", "ip", "card", "phone", "valid", "usual_length", "grouped", "bracketed", "after_letter", "after_digit", "after_space", "before_letter", "before_digit", "before_space", "before_mark", "plain_at", *CUES, "plus", "spelled", "short_parts", "known_end")
CHUNK = 256


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The sum of all digits, every second from the right doubled (less 9 above 9), is a multiple of 10."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        value = F.regexp_replace(value, r" ?[\[(](?:\.|dot)[\])] ?", ".")
        return value.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?(?:\.|$)){4}$") & ~value.rlike(r"\.\.|^\.|\.$")
    n = F.length(digits_of(value))
    # sequence() in luhn needs a digit; the length test comes first
    return F.when(n.between(12, 19), luhn(digits_of(value))).otherwise(False) if kind == "card" else n.between(9, 15)


def _found(df: DataFrame, column: str, pattern: str, hint: str) -> DataFrame:
    """column: array of (start, end, value, around, before, after) of the pattern's matches in `text`, in code points."""
    there = F.col("text").rlike(hint)
    none = F.array().cast("array<string>")
    df = df.withColumn("_m", F.when(there, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn("_p", F.when(F.size("_m") > 0, F.split("text", pattern, -1)).otherwise(none))
    df = df.withColumn("_gap", F.transform("_p", F.length)).withColumn("_step", F.zip_with(F.slice("_gap", F.lit(1), F.size("_m")), F.transform("_m", F.length), lambda g, n: g + n))
    # prefix sums by chunks, so that many matches in a text don't cost their square
    df = df.withColumn("_sum", F.transform(F.sequence(F.lit(0), F.floor(F.size("_m") / CHUNK).cast("int")), lambda c: F.aggregate(F.slice("_step", c * CHUNK + 1, F.lit(CHUNK)), F.lit(0), lambda a, x: a + x)))
    df = df.withColumn("_off", F.transform("_sum", lambda x, c: F.aggregate(F.slice("_sum", F.lit(1), c), F.lit(0), lambda a, y: a + y)))

    def span(value: Column, i: Column) -> Column:
        c = F.floor(i / CHUNK).cast("int")
        start = F.get("_off", c) + F.aggregate(F.slice("_step", c * CHUNK + 1, i % CHUNK), F.lit(0), lambda a, x: a + x) + F.get("_gap", i)
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), F.right(F.get("_p", i), F.lit(AROUND)).alias("around"), F.right(F.get("_p", i), F.lit(1)).alias("before"), F.left(F.get("_p", i + 1), F.lit(1)).alias("after"))

    return df.withColumn(column, F.transform("_m", span)).drop("_m", "_p", "_gap", "_step", "_sum", "_off")


def _bits(kind: str, x: Column) -> Column:
    value, n = x["value"], F.length(digits_of(x["value"]))
    usual = {"email": value.rlike(r"(?:[.)\]] ?| dot )[A-Za-z]{2,6}$"), "ip": F.length(value).between(7, 15), "card": n.isin(15, 16), "phone": n.between(10, 13)}[kind]
    tests = {
        **{k: F.lit(k == kind) for k in KINDS}, "valid": valid(kind, value), "usual_length": usual, "grouped": value.rlike("[ -]"), "bracketed": value.rlike(r"[(\[]"),
        "after_letter": x["before"].rlike(r"\p{L}"), "after_digit": x["before"].rlike("[0-9]"), "after_space": x["before"].rlike(r"\s") | (x["before"] == ""),
        "before_letter": x["after"].rlike(r"\p{L}"), "before_digit": x["after"].rlike("[0-9]"), "before_space": x["after"].rlike(r"\s") | (x["after"] == ""), "before_mark": x["after"].rlike(r"[.,;:!?)]"),
        "plain_at": F.lit(kind == "email") & value.contains("@") & ~value.contains(" "), **{c: x["around"].rlike(p) for c, p in CUES.items()}, "plus": F.lit(kind == "phone") & value.startswith("+"),
        "spelled": F.lit(kind == "email") & value.contains(" at "), "short_parts": F.lit(kind == "ip") & ~value.rlike("[0-9]{2}"), "known_end": F.lit(kind == "email") & value.rlike(r"(?i)(?:[.)\]] ?| dot )(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$"),
    }
    return sum((F.when(F.coalesce(tests[b], F.lit(False)), 1 << i).otherwise(0) for i, b in enumerate(BITS)), F.lit(0))


def _valid_ones(kind: str, column: str) -> Column:
    return F.filter(column, lambda x: valid(kind, x["value"]))


def _named(k: int, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))


def _with_bits(k: int, column: str) -> Column:
    return F.transform(column, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"), _bits(KINDS[k], x).alias("bits")))


def _of_kind(k: int) -> Column:
    return F.filter("base", lambda b: b["kind"] == k)


def candidates(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, fold, base (start, kind, end), proposed (start, kind, end, bits), of every row; kind: place in KINDS."""
    df = docs.select(*keep, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base, proposed = [], []
    for k, kind in enumerate(KINDS):
        df = _found(df, f"_base{k}", BASE[kind], HINT[kind])
        base.append(_named(k, _valid_ones(kind, f"_base{k}")))
        for j, pattern in enumerate(PROPOSED[kind]):
            df = _found(df, f"_more{k}_{j}", pattern, HINT[kind])
            proposed.append(_with_bits(k, f"_more{k}_{j}"))
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return df.select(*keep, "doc_id", fold.alias("fold"), F.array_sort(F.concat(*base)).alias("base"), F.array_distinct(F.concat(*proposed)).alias("proposed"))


class Boosted:
    """Trees of depth two over bits: (bit, bit where it is 0, bit where it is 1, four leaves)."""

    def __init__(self, trees: list[tuple], start: float, thresholds: dict[int, float]):
        self.trees, self.start, self.thresholds = trees, start, thresholds

    def raw(self, bits: np.ndarray) -> np.ndarray:
        total = np.full(len(bits), self.start)
        for top, zero, one, leaves in self.trees:
            side = bits >> top & 1
            total += np.array(leaves)[2 * side + (bits >> np.where(side, one, zero) & 1)]
        return total

    def expression(self, bits: Column) -> Column:
        on = lambda b: F.getbit(bits, F.lit(b)) == 1
        total = F.lit(self.start)
        for top, zero, one, (a, b, c, d) in self.trees:
            total = total + F.when(on(top), F.when(on(one), d).otherwise(c)).otherwise(F.when(on(zero), b).otherwise(a))
        return total


def boost(bits: np.ndarray, right: np.ndarray, wrong: np.ndarray, rounds: int = 60, rate: float = 0.3, ridge: float = 1.0) -> Boosted:
    """Newton boosting of the logistic loss over patterns of bits, of which right were personal data and wrong weren't."""
    n = right + wrong
    start = float(np.log((right.sum() + 1) / (wrong.sum() + 1)))
    model = Boosted([], start, {})
    on = (bits[:, None] >> np.arange(len(BITS)) & 1).astype(bool)
    f = np.full(len(bits), start)
    for _ in range(rounds if len(bits) else 0):
        p = 1 / (1 + np.exp(-f))
        g, h = right - n * p, n * p * (1 - p)
        gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + ridge)
        best = lambda m: max(range(len(BITS)), key=lambda b: gain(m & on[:, b]) + gain(m & ~on[:, b]))
        everywhere = np.ones(len(bits), bool)
        top = best(everywhere)
        zero, one = best(~on[:, top]), best(on[:, top])
        parts = [~on[:, top] & ~on[:, zero], ~on[:, top] & on[:, zero], on[:, top] & ~on[:, one], on[:, top] & on[:, one]]
        leaves = [rate * float(g[m].sum() / (h[m].sum() + ridge)) for m in parts]
        model.trees.append((top, zero, one, leaves))
        for m, leaf in zip(parts, leaves):
            f[m] += leaf
    return model


def calibrate(model: Boosted, bits: np.ndarray, right: np.ndarray, wrong: np.ndarray, precision: float = 0.98) -> None:
    """Per kind, the lowest raw score from which proposals of the held-out fold are right with this precision; where
    there is none, no proposal of the kind is taken."""
    raw = model.raw(bits)
    for k in range(len(KINDS)):
        model.thresholds[k] = float("inf")
        own = np.flatnonzero(bits >> k & 1)
        order = own[np.argsort(-raw[own], kind="stable")]
        good, all_ = np.cumsum(right[order]), np.cumsum(right[order] + wrong[order])
        for i, at in enumerate(order):
            last = i + 1 == len(order) or raw[order[i + 1]] < raw[at]
            if last and good[i] >= precision * all_[i] and good[i]:
                model.thresholds[k] = float(raw[at])


TRAINING = 4000


def training_texts(n: int = TRAINING, seed: int = 8) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """n seeded texts and their spans (start, kind, end), by kind in turn; of each kind half are look-alikes."""
    r = random.Random(seed)
    pick, digits = r.choice, lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(pick(["ba", "ke", "lo", "mi", "nu", "ra", "se", "ti", "vo", "zan", "der", "ing"]) for _ in range(r.randint(1, 4)))
    prose = lambda k: " ".join(word() for _ in range(r.randint(1, k)))

    def luhn_number(k: int) -> str:
        body = pick("3456") + digits(k - 2)
        total = sum(int(c) if i % 2 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(body)))
        return body + str(-total % 10)

    def cut(number: str, sizes: tuple[int, ...], mark: str) -> str:
        at = np.cumsum([0, *sizes]).tolist()
        return mark.join(number[a:z] for a, z in zip(at, at[1:]))

    def email() -> str:
        at, dot = pick([("@", "."), ("@", "."), (" @ ", "."), (" [at] ", "."), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), ("@", " [dot] ")])
        return pick([word(), f"{word()}.{word()}", word() + digits(2)]) + at + dot.join([*(word() for _ in range(r.randint(1, 2))), pick(["com", "org", "net", "de", "fr", "es", "io", "edu"])])

    octets = lambda: [str(r.randint(0, 255)) for _ in range(4)]
    phones = [lambda: f"+{r.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"+{pick('123456789')}{digits(r.randint(9, 11))}", lambda: f"+{r.randint(1, 99)} {digits(3)} {digits(3)} {digits(4)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"{digits(3)}.{digits(3)}.{digits(4)}", lambda: f"00{r.randint(1, 99)} {digits(3)} {digits(3)} {digits(3)}"]
    right = [
        email, lambda: pick([".", ".", ".", "[.]", " [dot] ", "(.)"]).join(octets()),
        lambda: pick([lambda: luhn_number(r.choice([15, 16])), lambda: cut(luhn_number(16), (4, 4, 4, 4), pick(["-", " ", ".", "/", "_"])), lambda: cut(luhn_number(15), (4, 6, 5), pick("- "))])(),
        lambda: pick(phones)(),
    ]
    cues = [["mail", "e-mail:", "write to", "contact"], ["server", "ip", "host", "login from"], ["card", "visa", "credit card", "charge"], ["tel.", "call", "phone:", "mobile"]]
    number = ["version", "section", "order", "invoice", "part", "ref", "serial", "item", "no.", "tracking", "ticket", "#"]
    wrong = [
        lambda: pick([lambda: (prose(3), f"{r.randint(1, 9)} @ {r.randint(1, 99)}.{digits(2)}"), lambda: (prose(3), f"{word()} at {word()} dot {word()}"), lambda: ("version", f"{word()} @ {r.randint(1, 9)}.{r.randint(0, 9)}"), lambda: (prose(2), f"{word()} @ {word()} . {word().capitalize()}")])(),
        lambda: pick([lambda: (pick(["version", "section", "release", "v", "build", "chapter"]), ".".join(str(r.randint(0, 12)) for _ in range(4))), lambda: (prose(2), ".".join(str(r.randint(256, 999)) for _ in range(4)))])(),
        lambda: pick([lambda: (pick(number), luhn_number(16)), lambda: (pick(number), cut(luhn_number(16), (4, 4, 4, 4), pick("-./"))), lambda: (prose(3), digits(16)), lambda: (pick(number), digits(r.randint(12, 19)))])(),
        lambda: (pick(number), pick([f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"00{digits(2)} {digits(4)} {digits(4)}"])),
    ]
    out = []
    for i in range(n):
        k, real = i % 4, (i // 4) % 2 == 0
        cue, value = (pick([*cues[k], prose(4)]), right[k]()) if real else wrong[k]()
        head = f"{prose(6)} {cue} "
        out.append((head + value + pick([".", ",", " ", "!", " - "]) + " " + prose(5), [(len(head), k, len(head) + len(value))] if real else []))
    return out


def trained(spark: SparkSession, n: int = TRAINING, seed: int = 8) -> Boosted:
    """Boost over the proposals of training_texts(n, seed); the driver gets one row a pattern of bits."""
    rows = [{"doc_id": i, "text": t, "spans": [{"start": a, "kind": k, "end": z} for a, k, z in spans]} for i, (t, spans) in enumerate(training_texts(n, seed))]
    texts = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<doc_id:long,text:string,spans:array<struct<start:int,kind:int,end:int>>>>")))
    found = candidates(written(texts, "training"), "spans").select("fold", "spans", F.explode("proposed").alias("p"))
    right = F.exists("spans", lambda b: (b["start"] == F.col("p.start")) & (b["kind"] == F.col("p.kind")) & (b["end"] == F.col("p.end")))
    # what lies inside a written span is never added on its own
    part = F.exists("spans", lambda b: (b["start"] <= F.col("p.start")) & (F.col("p.end") <= b["end"]) & (b["end"] - b["start"] > F.col("p.end") - F.col("p.start")))
    found = found.where(~part)
    got = found.groupBy("fold", F.col("p.bits").alias("bits")).agg(F.count_if(right).alias("right"), F.count_if(~right).alias("wrong")).orderBy("fold", "bits").collect()
    table = np.array([[int(r.fold), r.bits, r.right, r.wrong] for r in got], np.int64).reshape(-1, 4)
    learn, rest = table[table[:, 0] == 0], table[table[:, 0] == 1]
    model = boost(learn[:, 1], learn[:, 2].astype(float), learn[:, 3].astype(float))
    calibrate(model, rest[:, 1], rest[:, 2], rest[:, 3])
    return model


#: A span as one whole number, so that arrays of spans are compared by hashing.
def _key(x: Column) -> Column:
    return F.shiftleft(x["start"].cast("long"), 32) + F.shiftleft((x["end"] - x["start"]).cast("long"), 2) + x["kind"].cast("long")


def _span(key: Column) -> Column:
    start = F.shiftright(key, 32)
    return F.struct(start.cast("int").alias("start"), key.bitwiseAND(F.lit(3)).cast("int").alias("kind"), (start + F.shiftright(key.bitwiseAND(F.lit(0xFFFFFFFF)), 2)).cast("int").alias("end"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added (spans beyond the base), of every row of docs.

    docs: doc_id, text (others are ignored); model: what accepts proposals, trained() where none is given. Null and empty
    texts have no spans; repeated rows each give a row; an empty table gives none. A proposal is added if it is valid
    (checksum, octets, length), its score reaches its kind's threshold, and no base span overlaps it, unless it
    contains that span, is longer and of its kind; of added spans, one that lies in its neighbour is left out. Texts of
    any length are read whole; the patterns use no recursion.
    """
    model = model or trained(docs.sparkSession)
    limit = F.create_map(*[F.lit(x) for k in range(len(KINDS)) for x in (k, model.thresholds[k])])
    good = F.filter("proposed", lambda p: (F.getbit(p["bits"], F.lit(BITS.index("valid"))) == 1) & (model.expression(p["bits"]) >= F.element_at(limit, p["kind"])))
    inside = lambda b, p: (b["kind"] == p["kind"]) & (p["start"] <= b["start"]) & (b["end"] <= p["end"]) & (b["end"] - b["start"] < p["end"] - p["start"])
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = candidates(docs).withColumn("good", F.when(F.size("proposed") > 0, F.array_sort(F.array_except(F.transform(good, _key), F.transform("base", _key)))))
    found = found.withColumn("good", F.when(F.size("good") > 0, F.filter(F.transform("good", _span), lambda p: ~F.exists("base", lambda b: (b["start"] < p["end"]) & (p["start"] < b["end"]) & ~inside(b, p)))).otherwise(none))
    covered = lambda p, q: F.coalesce((q["start"] <= p["start"]) & (p["end"] <= q["end"]), F.lit(False))
    found = found.withColumn("more", F.filter("good", lambda p, i: ~covered(p, F.get("good", i - 1)) & ~covered(p, F.get("good", i + 1))))
    counts = [F.size(_of_kind(k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "more"))).alias("spans"), F.size("more").cast("long").alias("n_added"))


def redact(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, text with every span of `spans` (doc_id, spans as find_pii gives them) as [KIND]; rows of one doc_id
    must have one text. Overlapping spans become one, named by the first."""
    parts = F.transform(F.filter(F.split("spans", ","), lambda s: s != ""), lambda s: F.split(s, ":"))
    step = lambda acc, s: F.when(s[1].cast("int") < acc["at"], F.struct(F.greatest(acc["at"], s[2].cast("int")).alias("at"), acc["out"].alias("out"))).otherwise(
        F.struct(s[2].cast("int").alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s[1].cast("int") - acc["at"]), F.lit("["), F.upper(s[0]), F.lit("]")).alias("out"))
    )
    joined = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(spans.select("doc_id", "spans").distinct(), "doc_id", "left")
    done = F.aggregate(F.coalesce(parts, F.array().cast("array<array<string>>")), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return joined.select("doc_id", done.alias("text"))
