"""Secret scans by a trigram inverted index.

A Boolean trigram query is derived from each rule's pattern: a choice of sets of trigrams, one set of
which stands in any text that matches (in lower case). The index lists, for each trigram of any
query, the documents that hold it; a rule's candidates are the documents whose postings meet all
trigrams of one of its sets, and only these are verified with the pattern. A pattern with a way to
match without three certain characters in a row has no query, and is run over every text.

Spans are found without position functions: the gaps between matches and the matches alternate, so a
running sum of both lengths gives every start.

Defined results: a null or empty text has no spans; repeated rows get equal rows; matches of a kind
are leftmost and do not overlap, and those of too few characters are dropped after matching; spans of several kinds
that begin alike stand in the order of the rules. Very long texts are searched whole. An empty table gives no rows. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estratia.llm.common import whole


@dataclass(frozen=True)
class Rule:
    """A pattern; ``least`` characters of ``group`` at least."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


# The rules, the base kinds first.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{30,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
)
GAP = "\0"
#: A larger choice counts as a gap, which only weakens the query.
MAX_WAYS, MAX_CHOICE = 64, 5


def _ways(items) -> list[str]:
    """Strings with gaps, one for each way a parsed pattern can match."""
    ways = [""]
    for kind, value in items:
        if kind is op.LITERAL:
            more = [chr(value).lower()]
        elif kind is op.SUBPATTERN:
            more = _ways(value[3])
        elif kind is op.BRANCH:
            more = [w for branch in value[1] for w in _ways(branch)]
        elif kind is op.IN and len(value) <= MAX_CHOICE and all(k is op.LITERAL for k, _ in value):
            more = sorted({chr(v).lower() for _, v in value})
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            least, most, body = value
            inner = _ways(body)
            if (least, most) == (0, 1):
                more = [GAP] if any(len(w.strip(GAP)) > 1 or GAP in w for w in inner) or len(inner) > 1 else ["", *inner]
            else:
                more = [w + GAP * (most > 1) for w in inner] if least else [GAP]
        elif kind is op.AT:
            more = [""]
        else:
            more = [GAP]
        if len(ways) * len(more) > MAX_WAYS:
            more = [GAP]
        ways = sorted({a + b if not (a.endswith(GAP) and b == GAP) else a for a in ways for b in more})
    return ways


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The sets of trigrams of which a matching text, in lower case, holds one whole; None: run it on all."""
    sets = set()
    for way in _ways(parser.parse(pattern)):
        grams = {part[i : i + 3] for part in way.split(GAP) for i in range(len(part) - 2)}
        if not grams:
            return None
        sets.add(frozenset(grams))
    return sorted((s for s in sets if not any(t < s for t in sets)), key=sorted)


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, tie, kinds: the rules that the index cannot rule out. ``docs`` has doc_id, tie, text."""
    asked = [(r.kind, f"{r.kind}{i}", g, len(s)) for r in rules for i, s in enumerate(trigram_query(r.pattern) or ()) for g in sorted(s)]
    grams = sorted({g for _, _, g, _ in asked})
    low = docs.select("doc_id", "tie", F.lower("text").alias("l_"))
    held = F.array_compact(F.array(*(F.when(F.col("l_").contains(g), F.lit(g)) for g in grams)))
    postings = low.select("doc_id", "tie", F.explode(held).alias("gram"))
    query = docs.sparkSession.createDataFrame(asked, "kind string, clause string, gram string, size int")
    # The query table has one row for each trigram of the rules, whatever the documents are
    met = postings.join(F.broadcast(query), "gram").groupBy("doc_id", "tie", "kind", "clause")
    met = met.agg(F.count_distinct("gram").alias("c"), F.max("size").alias("size")).where("c = size")
    return met.groupBy("doc_id", "tie").agg(F.collect_set("kind").alias("kinds"))


def _matches(rule: Rule, at: int) -> Column:
    """at, i, gap, n, m of every match: the characters before it since the last, its own, and of its group."""
    lengths = lambda c: F.transform(c, lambda x: F.length(x))
    pattern = F.lit(rule.pattern)
    n = lengths(F.regexp_extract_all("text", pattern, F.lit(0)))
    m = lengths(F.regexp_extract_all("text", pattern, F.lit(rule.group))) if rule.group else n
    gaps = lengths(F.split("text", rule.pattern))
    each = F.arrays_zip(n.alias("n"), m.alias("m"), F.slice(gaps, 1, F.size(n)).alias("gap"))
    return F.transform(each, lambda x, i: F.struct(F.lit(at).alias("at"), i.alias("i"), x["gap"].alias("gap"), x["n"].alias("n"), x["m"].alias("m")))


def spans(docs: DataFrame, rules=RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tie, found: the sorted spans (begin, at, end) of each document that has any; at is the rule's place."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text")).where("text <> ''").withColumn("tie", F.md5("text"))
    scanned = [(at, r) for at, r in enumerate(rules) if trigram_query(r.pattern) is None]
    indexed = [(at, r) for at, r in enumerate(rules) if trigram_query(r.pattern) is not None]
    none = F.array().cast("array<struct<at:int,i:int,gap:int,n:int,m:int>>")
    hits = docs.select("doc_id", "tie", F.flatten(F.array(*(F.when(F.col("text").rlike(r.pattern), _matches(r, at)).otherwise(none) for at, r in scanned), none)).alias("h_"))
    hits = hits.where(F.size("h_") > 0)
    possible = candidates(docs, rules)
    possible = possible.select(F.col("doc_id").alias("d_"), F.col("tie").alias("e_"), "kinds")
    texts = docs.join(possible, docs["doc_id"].eqNullSafe(possible["d_"]) & (docs["tie"] == possible["e_"]))
    verified = [F.when(F.array_contains("kinds", r.kind) & F.col("text").rlike(r.pattern), _matches(r, at)).otherwise(none) for at, r in indexed]
    more = texts.select("doc_id", "tie", F.flatten(F.array(*verified, none)).alias("h_")).where(F.size("h_") > 0)
    rows = hits.union(more).select("doc_id", "tie", F.explode("h_").alias("h")).select("doc_id", "tie", "h.*").distinct()
    upto = Window.partitionBy("doc_id", "tie", "at").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(upto))
    least = F.coalesce(*(F.when(F.col("at") == at, F.lit(r.least)) for at, r in enumerate(rules)))
    rows = rows.where(F.col("m") >= least)
    found = F.struct((F.col("end") - F.col("n")).alias("begin"), "at", "end")
    return rows.groupBy("doc_id", "tie").agg(F.sort_array(F.collect_list(found)).alias("found"))


def report(docs: DataFrame, rules=RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: doc_id, found (as of ``spans``, empty for none)."""
    found = spans(docs, rules, doc_id, text).select(F.col("doc_id").alias("d_"), F.col("tie").alias("e_"), "found")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.md5(whole(text)).alias("tie"))
    rows = rows.join(found, rows["doc_id"].eqNullSafe(found["d_"]) & (F.col("tie") == F.col("e_")), "left")
    none = F.array().cast("array<struct<begin:bigint,at:int,end:bigint>>")
    return rows.select("doc_id", F.coalesce("found", none).alias("found"))
