"""PII (operator 8): base patterns of four kinds as seeds, and bootstrapped contextual extraction for what they miss.

One pass over the whole texts finds the base spans and, elsewhere, candidates (digit groups, tokens with @). Every mention of either has lexical
patterns: the words around it. Spark then scores the pattern-instance graph: a pattern's score for a kind is the confidence of its distinct instances
over that plus its conflicts (seeds of other kinds, candidates of unfitting shape), seeds counting 1; fitting candidates that nothing is known of are
no conflict, but less than half of the fitting instances; an instance's confidence is the noisy-or over its accepted patterns; a few rounds. Candidates next to an accepted pattern (enough seeds,
high score, fitting shape) become spans of its kind. Base spans always stay. Secrets (keys, tokens) have no base pattern: their seeds are strings of 32 characters and more
that mix letters and digits, and like candidates (16 and more) they become spans only next to an accepted pattern.

Cases: null text has no spans; an empty table gives an empty result; repeated rows are scanned each, and count as one instance in the graph; ties between
kinds go to the higher score, then the kind listed first; texts of any length are scanned whole and in linear time (neighbours come from one list of a text's words, cut
where a mention begins or ends); in a row of numbers a number ends where it would pass 19 digits, or where two of 7 digits and more meet; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import materialise, table

#: Kinds of base spans in the order of ties, and the one that only contexts find.
KINDS = ("email", "ip", "card", "phone")
SECRET = len(KINDS)
NAMES = (*KINDS, "secret")
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"(?<![0-9A-Za-z])[0-9][0-9 ().-]*[0-9](?![0-9A-Za-z])")
_PIECE = re.compile(r"[^ ]+")
_AT = re.compile(r"(?:(?<![^\s@])[^\s@]++)?@[^\s@]*+")
_WHOLE = re.compile(r"\S+")
_EDGE = ".,;!?()[]{}<>\"'"
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the four base patterns, leftmost and non-overlapping per kind."""
    out = []
    last = 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((0, start, m.end()))
                last = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
                out.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


def _fits(text: str) -> int:
    """Bits of the kinds whose shape a candidate has."""
    digits = len(_DIGIT.findall(text))
    return (1 if "@" in text[1:-1] else 0) | (2 if digits >= 4 and text.count(".") >= 3 else 0) | (4 if 12 <= digits <= 19 else 0) | (8 if 7 <= digits <= 15 else 0)


def numbers(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Places of the numbers in a row of digit groups: groups join at spaces until 19 digits, but two of 7 digits and more are numbers of their own."""
    begin = last = have = 0
    for m in _PIECE.finditer(text, start, end):
        digits = len(_DIGIT.findall(m[0]))
        if have and (have + digits > 19 or (have >= 7 and digits >= 7)):
            yield begin, last
            have = 0
        if digits:
            begin, last, have = (begin if have else m.start()), m.end(), have + digits
    if have:
        yield begin, last


class Words:
    """Words of a text in order, cut where a mention begins or ends, so that all of them together are as long as the text."""

    def __init__(self, text: str, cuts: list[int]) -> None:
        self.text, self.starts, self.ends = text, [], []
        for m in _WHOLE.finditer(text):
            at = m.start()
            for cut in cuts[bisect_right(cuts, at) : bisect_left(cuts, m.end())]:
                self.starts.append(at)
                self.ends.append(cut)
                at = cut
            self.starts.append(at)
            self.ends.append(m.end())

    def _plain(self, i: int) -> str:
        return _DIGIT.sub("0", self.text[self.starts[i] : self.ends[i]].strip(_EDGE).lower())

    def patterns(self, start: int, end: int) -> list[str]:
        """Words around a mention: one before, two before, one before and one behind. Digits read as 0."""
        i, j = bisect_right(self.ends, start), bisect_left(self.starts, end)
        before = [w for w in map(self._plain, range(max(0, i - 3), i)) if w][-2:]
        behind = [w for w in map(self._plain, range(j, min(j + 1, len(self.starts)))) if w]
        out = []
        if before:
            out.append(f"{before[-1]} _")
            if len(before) == 2:
                out.append(f"{before[0]} {before[1]} _")
            if behind:
                out.append(f"{before[-1]} _ {behind[0]}")
        return out


def _opaque(text: str) -> bool:
    """Whether a string mixes letters and digits as keys do: two digits and two letters at least."""
    digits = len(_DIGIT.findall(text))
    return digits >= 2 and sum(c.isalpha() for c in text) >= 2


def _free(places: list[tuple[int, int]], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Places in order that meet none of the taken ones. Both sorted."""
    i = 0
    for s, e in places:
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if i == len(taken) or taken[i][0] >= e:
            yield s, e


def mentions(text: str) -> tuple[list, list]:
    """Base spans; and mentions (kind or -1, start, end, instance, fitting kinds, patterns) of seeds, those of secrets among them, and candidates."""
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    places, keys = [], []
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            places += numbers(text, m.start(), m.end())
        keys = [(m.start(), m.end()) for m in _OPAQUE.finditer(text) if _opaque(m[0])]
    if "@" in text:
        places += [(m.start(), m.end()) for m in _AT.finditer(text)]
    found = [(k, s, e, text[s:e].lower(), 0) for k, s, e in base]
    found += [(-1, s, e, text[s:e].lower(), bits) for s, e in _free(sorted(places), taken) if (bits := _fits(text[s:e]))]
    found += [(SECRET if e - s >= 32 else -1, s, e, text[s:e], 1 << SECRET) for s, e in _free(keys, taken)]
    if not found:
        return base, []
    words = Words(text, sorted({x for f in found for x in f[1:3]}))
    near = [(*f, words.patterns(f[1], f[2])) for f in found]
    return base, near[: len(base)] + [f for f in near[len(base) :] if f[5]]


_SCAN = "doc_id long, base array<struct<kind:int,s:int,e:int>>, found array<struct<kind:int,s:int,e:int,inst:string,bits:int,pats:array<string>>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base_kind = pa.list_(pa.struct([("kind", pa.int32()), ("s", pa.int32()), ("e", pa.int32())]))
    found_kind = pa.list_(pa.struct([("kind", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("inst", pa.string()), ("bits", pa.int32()), ("pats", pa.list_(pa.string()))]))
    for batch in batches:
        bases, founds = [], []
        for text in batch.column("text").to_pylist():
            base, found = mentions(text or "")
            bases.append([{"kind": k, "s": s, "e": e} for k, s, e in base])
            founds.append([dict(zip(("kind", "s", "e", "inst", "bits", "pats"), x, strict=True)) for x in found])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bases, base_kind), pa.array(founds, found_kind)], names=["doc_id", "base", "found"])


def accepted_patterns(each: DataFrame, rounds: int = 3, min_seeds: int = 5, min_score: float = 0.9, min_known: float = 0.5) -> DataFrame:
    """pattern, kind, score of the accepted patterns. each: kind, inst, bits, pattern of every mention.

    min_seeds: distinct seed instances a pattern needs. Only patterns with so many seeds, and their instances, enter the rounds.
    min_known: confidence a pattern needs as a share of its fitting instances, so that a few seeds do not carry a context of other numbers.
    """
    edges = each.groupBy("pattern", "inst").agg(F.max("kind").alias("kind"), F.max("bits").alias("bits"))
    seeded = edges.where("kind >= 0").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds")).where(F.col("seeds") >= min_seeds)
    seeded = materialise(seeded, "seeded")
    graph = materialise(edges.join(seeded.select("pattern").distinct(), "pattern", "left_semi"), "graph")
    kinds = graph.withColumnRenamed("kind", "own").join(seeded.select("pattern", "kind"), "pattern")
    fits = F.when(F.col("own") >= 0, F.col("own") == F.col("kind")).otherwise(_fitting())
    total = materialise(kinds.groupBy("pattern", "kind").agg(F.count_if(fits).alias("fit"), F.count_if(~fits).alias("against")), "evidence")
    sure = graph.where("kind >= 0").select("inst", "kind").distinct().withColumn("conf", F.lit(1.0))
    now = sure
    for step in range(rounds):
        mass = graph.select("pattern", "inst").join(now, "inst").groupBy("pattern", "kind").agg(F.sum("conf").alias("mass"))
        scored = seeded.join(mass, ["pattern", "kind"]).join(total, ["pattern", "kind"]).where(F.col("mass") >= min_known * F.col("fit"))
        best = scored.select("pattern", "kind", (F.col("mass") / (F.col("mass") + F.col("against"))).alias("score")).where(F.col("score") >= min_score)
        best = materialise(best, "patterns")
        if step + 1 < rounds:
            fresh = graph.where("kind < 0").select("pattern", "inst", "bits").join(best, "pattern").where(_fitting())
            fresh = fresh.groupBy("inst", "kind").agg((1 - F.exp(F.sum(F.log(1 - 0.99 * F.col("score"))))).alias("conf"))
            now = materialise(sure.union(fresh), "instances")
    return best


def _fitting() -> Column:
    """Whether bits hold the kind's bit."""
    return sum((F.when(F.col("kind") == i, F.col("bits").bitwiseAND(F.lit(1 << i))).otherwise(0) for i in range(SECRET + 1)), F.lit(0)) > 0


def _written(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas. spans: array of (s, kind, e)."""
    names = F.array(*[F.lit(k) for k in NAMES])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", names[x["kind"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row of docs: the id, base counts, base_sha256, spans (base and discovered, secrets among them), n_found (discovered ones of the four kinds), n_secret, n_spans (all)."""
    scanned = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan, _SCAN)
    rows = materialise(scanned.withColumn("row", F.monotonically_increasing_id()), "mentions")
    each = rows.select("row", F.inline("found")).select("row", "kind", "s", "e", "inst", "bits", F.explode("pats").alias("pattern"))
    best = accepted_patterns(each, **options)
    new = each.where((F.col("kind") < 0) | (F.col("kind") == SECRET)).drop("kind").join(best, "pattern").where(_fitting())
    new = new.groupBy("row", "s", "e").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b"))
    more = new.groupBy("row").agg(F.collect_list(F.struct("s", (-F.col("b.k")).alias("kind"), "e")).alias("more"))
    base = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e")))
    empty = F.array().cast("array<struct<s:int,kind:int,e:int>>")
    count = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    secret = lambda yes: F.size(F.filter("more", lambda x: (x["kind"] == SECRET) == F.lit(yes))).cast("long")
    out = rows.join(more, "row", "left").withColumn("more", F.coalesce("more", empty))
    return out.select(
        F.col("doc_id").alias(id_col), *[count(i) for i in range(4)], F.sha2(_written(base), 256).alias("base_sha256"), _written(F.concat(base, "more")).alias("spans"),
        secret(False).alias("n_found"), secret(True).alias("n_secret"), (F.size("base") + F.size("more")).cast("long").alias("n_spans"),
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
