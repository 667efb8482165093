"""Personal data: candidates from generous patterns, chosen by boosted trees.

Generators propose spans, which may overlap: those of the base patterns, valid
or not, and looser ones (addresses with the signs written out, telephone
numbers without a plus sign, numbers that the base patterns read as one with
their neighbours). Each candidate has format and context features,
all yes or no. Candidates of the base patterns are labelled by their own
check (range, checksum, number of digits), which is no feature; boosted trees
of depth two learn it from the features. Base spans of addresses are always
valid; theirs, and those written out, are labelled by a plausible local part
and ending. Each kind's threshold is the lowest score above which, on the
held-out half of the documents, candidates pass the check almost always. Where
there are too few to tell, or none that fails, it is the kind's prior one.
Valid base spans always stay; other candidates stay if they pass their kind's
check, from its threshold on.

Columns and aggregates only. What the trees learn from is one row per pattern
of features, kind and half, at most ``8 * 2**13`` rows whatever the corpus.
All patterns are written without nested repetition, so that neither long runs
of one kind of character nor long lists make them slow or deep.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from voxtally.llm.common import held_out, under_safe_names, whole_text
from voxtally.session import materialize

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
ROUNDS = 40
RATE = 0.3
PRECISION = 0.99
#: At least so many held-out candidates must lie above a threshold.
SUPPORT = 50
#: Thresholds of the kinds with fewer held-out candidates, or without a failing one: from 0 on, so that the check alone decides.
PRIOR = (0.0, 0.0, 0.0, 0.0)
CONTEXT = 24

# Signs that stand for a separator inside an address or a number, so that runs are plain classes.
_DOT, _SEP, _OTHER = "", "", ""
_EMAIL = (
    rf"(?:\G|(?<![A-Za-z0-9._%+{_DOT}-]))[A-Za-z0-9._%+{_DOT}-]++@[A-Za-z0-9-]++{_DOT}[A-Za-z0-9{_DOT}-]*+"
)
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = rf"[0-9][0-9{_SEP}]++"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_WRITTEN_EMAIL = (
    r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Z0-9-]{1,63}+"
    r" ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[A-Z]{2,24}+"
)
_LOCAL_PHONE = r"(?<![0-9+.(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])"
_TRUNK_PHONE = r"(?<![0-9+.-])00[1-9][0-9 ().-]{8,18}[0-9](?![0-9])"
# Numbers that stand next to others, which the base patterns read as one.
_WHOLE_PHONE = r"\+[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
_WHOLE_CARD = (
    r"(?<![A-Za-z0-9])(?:[0-9]{14,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![A-Za-z0-9])"
)

_SPAN = "struct<start:int,end:int,kind:int,value:string>"
_CANDIDATE = "array<struct<start:int,end:int,kind:int,base:boolean,checked:boolean,ok:boolean,bits:int>>"

#: Context words, fixed values.
_WORDS = {
    EMAIL: "mail|contact|write|reply",
    IP: "ip|host|server|address|login",
    CARD: "card|visa|credit|pay|debit",
    PHONE: "phone|tel|call|mobile|fax",
}
#: Endings of addresses besides those of two letters.
_ENDINGS = "com|org|net|edu|gov|mil|int|info|biz|name|pro|dev|app|xyz|online|site|shop|store|cloud|tech|email|example|test|invalid"
_AGAINST = "version|release|order|isbn|invoice|section|serial"
N_FEATURES = 13


def _located(text: Column, pattern: str, kind: int) -> Column:
    """All matches with code point offsets, from the pieces between them."""
    pieces = F.split(text, pattern, -1)
    matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m, i: F.struct(m.alias("m"), F.get(pieces, i).alias("g")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["m"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
    return F.aggregate(matches, zero, step, lambda acc: acc["out"])


def _only_if(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether every second digit from the right, doubled, and the others sum to a multiple of ten."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        double = F.pmod(n - i, F.lit(2)) == 1
        return F.when(double & (d > 4), d * 2 - 9).when(double, d * 2).otherwise(d)

    return F.pmod(F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + worth(i)), F.lit(10)) == 0


def _valid(span: Column) -> Column:
    digits = _digits(span["value"])
    n = F.length(digits)
    parts = F.transform(F.split(span["value"], r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    small = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.try_to_number(p, F.lit("999")) <= 255))
    return (
        F.when(span["kind"] == EMAIL, F.lit(True))
        .when(span["kind"] == IP, F.coalesce(small, F.lit(False)))
        .when(span["kind"] == CARD, F.when((n >= 14) & (n <= 19), _luhn(digits)).otherwise(False))
        .otherwise((n >= 10) & (n <= 15))
    )


def _passes(span: Column) -> Column:
    """The check that candidates are labelled by; unlike validity it can fail for addresses."""
    value = F.lower(F.translate(span["value"], _DOT, "."))
    local = F.regexp_extract(value, r"^[^@ (\[{]*", 0)
    plausible = local.rlike("^[a-z0-9]") & ~local.rlike(r"[.%+-]$|\.\.") & value.rlike(rf"(?:[a-z0-9]\.|[)\]}}] ?)(?:{_ENDINGS}|[a-z]{{2}})$")
    return F.when(span["kind"] == EMAIL, plausible).otherwise(_valid(span))


def _bits(text: Column, span: Column) -> Column:
    """Format and context features as bits of one integer."""
    before = F.lower(F.substring(text, F.greatest(F.lit(1), span["start"] + 1 - CONTEXT), F.least(F.lit(CONTEXT), span["start"])))
    after = F.substring(text, span["end"] + 1, F.lit(1))
    value = F.translate(span["value"], _DOT + _SEP, ".-")
    n = F.length(_digits(value))
    own = F.lit(False)
    for kind, words in _WORDS.items():
        own = F.when(span["kind"] == kind, before.rlike(words)).otherwise(own)
    features = [
        own,
        before.rlike(_AGAINST),
        before.rlike("[a-z0-9]$"),
        after.rlike("[A-Za-z0-9]"),
        value.contains("-"),
        value.contains(" ") | value.contains("("),
        value.startswith("+") | value.startswith("00"),
        n >= 10,
        n >= 14,
        n >= 16,
        n >= 20,
        value.rlike("([0-9])\\1\\1\\1"),
        F.when(span["kind"] == IP, value.rlike("[0-9]{4}")).otherwise(value.rlike("@|at[)\\]}]")),
    ]
    return sum((F.when(F.coalesce(f, F.lit(False)), 1 << i).otherwise(0) for i, f in enumerate(features)), F.lit(0))


def with_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``_candidates``: all spans of all generators, by start, then kind."""
    text = whole_text(text_col)
    plain = F.when(text.rlike(f"[{_SEP}{_DOT}]"), F.translate(text, _SEP + _DOT, _OTHER * 2)).otherwise(text)
    rows = docs.select("*", plain.alias("_plain"))
    t = F.col("_plain")
    rows = rows.withColumns({
        "_dotted": F.when(t.contains("@"), F.regexp_replace(t, "(?<=[A-Za-z0-9-])\\.(?=[A-Za-z0-9-])", _DOT)),
        "_joined": F.when(t.rlike("[0-9][0-9 -]{12,}[0-9]"), F.regexp_replace(t, "(?<=[0-9])[ -](?=[0-9])", _SEP)),
    })
    base = F.concat(
        _only_if(F.col("_dotted").isNotNull(), _located(F.col("_dotted"), _EMAIL, EMAIL)),
        _only_if(t.rlike(r"[0-9]\.[0-9]"), _located(t, _IP, IP)),
        _only_if(F.col("_joined").isNotNull(), F.filter(
            _located(F.col("_joined"), _CARD, CARD), lambda s: F.length(s["value"]) >= 12)),
        _only_if(t.contains("+"), _located(t, _PHONE, PHONE)),
    )
    loose = F.concat(
        _only_if(t.rlike(r"(?i)[(\[{]at[)\]}]"), _located(t, _WRITTEN_EMAIL, EMAIL)),
        _only_if(t.rlike("[0-9]{3}[ .-][0-9]{4}"), _located(t, _LOCAL_PHONE, PHONE)),
        _only_if(t.contains("00"), _located(t, _TRUNK_PHONE, PHONE)),
        _only_if(t.contains("+"), _located(t, _WHOLE_PHONE, PHONE)),
        _only_if(F.col("_joined").isNotNull(), _located(t, _WHOLE_CARD, CARD)),
    )
    rows = rows.withColumns({"_base": base, "_loose": loose})

    def described(spans: Column, checked: bool) -> Column:
        return F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"),
            (_valid(s) if checked else F.lit(False)).alias("base"), (F.lit(True) if checked else s["kind"] == EMAIL).alias("checked"),
            _passes(s).alias("ok"), _bits(t, s).alias("bits")))

    found = F.concat(described(F.col("_base"), True), described(F.col("_loose"), False))
    some = (F.size("_base") > 0) | (F.size("_loose") > 0)
    rows = rows.withColumn("_found", F.when(some, found).otherwise(F.array().cast(_CANDIDATE)))
    in_order = F.array_sort(
        F.transform("_found", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
                                                 s["base"].alias("base"), s["checked"].alias("checked"), s["ok"].alias("ok"),
                                                 s["bits"].alias("bits"))))
    return rows.withColumn("_candidates", in_order).drop("_plain", "_dotted", "_joined", "_base", "_loose", "_found")


@dataclass(frozen=True)
class Trees:
    """Depth-two trees over bits and kinds, and each kind's threshold."""

    trees: tuple[tuple[int, tuple[int, int], tuple[float, float, float, float]], ...]
    start: float
    thresholds: tuple[float, ...]

    def score(self, bits: Column, kind: Column) -> Column:
        """The probability that a candidate passes its kind's check."""
        pattern = bits + F.when(kind == 0, 1 << N_FEATURES).otherwise(F.lit(0))
        for k in range(1, len(KINDS)):
            pattern = pattern + F.when(kind == k, 1 << (N_FEATURES + k)).otherwise(0)
        bit = lambda f: F.shiftright(pattern, f).bitwiseAND(1)
        total = F.lit(self.start)
        for root, (left, right), leaves in self.trees:
            first = F.when(bit(root) == 0, F.when(bit(left) == 0, leaves[0]).otherwise(leaves[1]))
            total = total + first.otherwise(F.when(bit(right) == 0, leaves[2]).otherwise(leaves[3]))
        return 1 / (1 + F.exp(-total))


def _matrix(rows: list[tuple[int, int]]) -> np.ndarray:
    """Features of patterns ``(bits, kind)``: the bits, and one column for each kind."""
    bits = np.array([[b >> i & 1 for i in range(N_FEATURES)] for b, _ in rows], dtype=float).reshape(-1, N_FEATURES)
    kinds = np.array([[k == i for i in range(len(KINDS))] for _, k in rows], dtype=float).reshape(-1, len(KINDS))
    return np.hstack([bits, kinds])


def boost(x: np.ndarray, positive: np.ndarray, negative: np.ndarray, rounds: int = ROUNDS, rate: float = RATE):
    """Newton boosting of the logistic loss on counted patterns; ties go to the lowest feature."""
    n = positive + negative
    start = math.log((positive.sum() + 1) / (negative.sum() + 1))
    margin, trees = np.full(len(x), start), []

    def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return g * g / (h + 1.0)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = positive - n * p, n * p * (1 - p)

        def best_split(inside: np.ndarray) -> tuple[float, int]:
            gi, hi = g * inside, h * inside
            g1, h1 = x.T @ gi, x.T @ hi
            gains = gain(g1, h1) + gain(gi.sum() - g1, hi.sum() - h1)
            return float(gains.max()), int(gains.argmax())

        options = []
        for root in range(x.shape[1]):
            (a, left), (b, right) = best_split(1 - x[:, root]), best_split(x[:, root])
            options.append((a + b, -root, left, right))
        _, root, left, right = max(options)
        root = -root
        leaf = np.where(x[:, root] == 0, x[:, left], 2 + x[:, right]).astype(int)
        leaves = tuple(rate * float(g[leaf == i].sum() / (h[leaf == i].sum() + 1.0)) for i in range(4))
        margin = margin + np.array(leaves)[leaf]
        trees.append((root, (left, right), leaves))
    return tuple(trees), start, margin


def fit(candidates: DataFrame, id_col: str = "doc_id", precision: float = PRECISION) -> Trees:
    """Trees from one half of the documents, thresholds from the other.

    Counts of feature patterns are all that leaves Spark: at most two halves
    of ``4 * 2**13`` patterns. A kind with less held-out candidates than the
    support, or without a single failed check to learn from, has its prior
    threshold. One that has both, but no threshold that is precise enough,
    keeps base spans only.
    """
    each = candidates.select(held_out(F.col(id_col), 2, 0).alias("half"), F.explode("_candidates").alias("c")).where("c.checked")
    counted = each.groupBy("half", "c.kind", "c.bits").agg(
        F.sum(F.col("c.ok").cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n")
    ).collect()
    counted.sort(key=lambda r: (r["half"], r["kind"], r["bits"]))
    learn = [r for r in counted if not r["half"]]
    if not learn:
        return Trees((), 0.0, PRIOR)
    x = _matrix([(r["bits"], r["kind"]) for r in learn])
    pos = np.array([r["pos"] for r in learn], dtype=float)
    neg = np.array([r["n"] - r["pos"] for r in learn], dtype=float)
    trees, start, _ = boost(x, pos, neg)
    margins = {}
    for r in counted:
        row = _matrix([(r["bits"], r["kind"])])[0]
        m = start
        for root, (left, right), leaves in trees:
            m += leaves[int(row[left]) if row[root] == 0 else 2 + int(row[right])]
        margins[r["kind"], r["bits"]] = 1 / (1 + math.exp(-m))
    thresholds = []
    for kind in range(len(KINDS)):
        of_kind = [r for r in counted if r["kind"] == kind]
        held = sorted((r for r in of_kind if r["half"]), key=lambda r: -margins[kind, r["bits"]])
        passed = total = 0
        best = math.inf
        for i, r in enumerate(held):
            passed, total = passed + r["pos"], total + r["n"]
            score = margins[kind, r["bits"]]
            last = i + 1 == len(held) or margins[kind, held[i + 1]["bits"]] < score
            if last and total >= SUPPORT and passed >= precision * total:
                best = score
        thresholds.append(best if total >= SUPPORT and any(r["pos"] < r["n"] for r in of_kind) else PRIOR[kind])
    return Trees(trees, start, tuple(thresholds))


def with_spans(candidates: DataFrame, trees: Trees) -> DataFrame:
    """Add ``spans``, the chosen ones by start, then kind, as ``array<struct<start, end, kind, base>>``.

    A further span has to pass its kind's check and reach its threshold. It is
    left out where it lies inside a longer candidate of its kind that passes,
    or in a base span.
    """
    base = F.filter("_candidates", lambda c: c["base"])
    rows = candidates.withColumn("_valid", base)
    able = [k for k in range(len(KINDS)) if trees.thresholds[k] < math.inf]
    c = F.col("_candidates")
    if able:
        def chosen(s: Column) -> Column:
            limit = F.lit(2.0)
            for k in able:
                limit = F.when(s["kind"] == k, trees.thresholds[k]).otherwise(limit)
            covered = F.exists("_candidates", lambda v: (
                (v["ok"] | v["base"]) & (v["kind"] == s["kind"]) & (v["start"] <= s["start"]) & (s["end"] <= v["end"])
                & (v["base"] | (v["end"] - v["start"] > s["end"] - s["start"]))))
            return s["base"] | (s["ok"] & (trees.score(s["bits"], s["kind"]) >= limit) & ~covered)

        c = F.filter("_candidates", chosen)
    else:
        c = F.col("_valid")
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    spans = F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), kind(s).alias("kind"), s["base"].alias("base")))
    return rows.withColumn("spans", F.array_distinct(spans)).drop("_valid", "_candidates")


def spans_text(spans: Column) -> Column:
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, spans)`` of every row, spans as ``array<struct<start, end, kind, base>>``.

    Offsets count code points, the end is exclusive. A null text counts as the
    empty one; both have no spans. A null id stays null, repeated rows have
    equal results, an empty table gives no rows, other columns are ignored.
    """
    found = materialize(with_candidates(docs.select(id_col, text_col), text_col).drop(text_col), "candidates")
    return with_spans(found, fit(found, id_col))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with ``[EMAIL]``, ``[IP]``, ``[CARD]`` or ``[PHONE]`` in place of what is found.

    Overlapping spans become one, named by the first. Rows without a span,
    those without a text included, stay as they are, and so do all columns.
    """
    return under_safe_names(docs, [id_col, text_col], lambda rows: _redacted(rows, id_col, text_col))


def _redacted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    columns = docs.columns
    found = with_candidates(docs, text_col)
    trees = fit(materialize(found.select(id_col, "_candidates"), "candidates"), id_col)
    spans = F.col("spans")
    text = F.col(text_col)

    def step(acc: Column, s: Column) -> Column:
        label = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        new = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), label)
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, piece).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    done = with_spans(found, trees).withColumn("_clean", F.when(F.size(spans) > 0, clean).otherwise(text))
    return done.select(*[F.col("_clean").alias(c) if c == text_col else c for c in columns])
