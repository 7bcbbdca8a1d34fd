"""Secret scans: regex rules behind a trigram inverted index (DataFrame functions only).

From each rule's regex follows a Boolean trigram query: an OR of ANDs over lower-cased trigrams, one AND for each literal that a match
must contain (`trigram_query`). The index holds the postings (trigram, id) of the trigrams that some query asks for, and is written once.
A rule's postings are intersected by counting, for each id and AND, how many of its trigrams the id has. Texts meet the candidates by id
and only those are verified with the regex; a rule without a mandatory trigram scans every text.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, fresh, split_by_ids, written


@dataclass(frozen=True)
class Rule:
    """kind: its name in spans. pattern: a regex whose syntax and meaning Java and RE2 share. group: the group whose length counts. least: characters it needs."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The three base rules. [0-9a-f]{16,} and AKIA[A-Z0-9]{14,} find what the unbounded forms find with the short matches dropped.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: What this method adds: openings of private keys.
ADDED = (Rule("pem", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),)


#: An alternative in a trigram query, and a set of strings that a part of a regex stands for, have so many entries at most; beyond, less is asked for.
CLAUSES, STRINGS = 64, 64
#: A query is an OR of ANDs; this one asks for nothing.
ANYTHING = (frozenset(),)
#: What Java and Python read differently in a pattern that both accept: comments and Unicode case flags, and the class operators.
_DIFFERENT = re.compile(r"\(\?[A-Za-z]*[uxU]|&&")


def _least(query) -> tuple[frozenset[str], ...]:
    """Without the ANDs that ask for more than another one."""
    kept = set(query)
    return tuple(sorted((a for a in kept if not any(b < a for b in kept)), key=sorted))


def _either(parts) -> tuple[frozenset[str], ...]:
    query = _least(a for q in parts for a in q)
    return query if len(query) <= CLAUSES else ANYTHING


def _both(left, right) -> tuple[frozenset[str], ...]:
    """Both queries; where that takes too many ANDs, the one of fewer."""
    if len(left) * len(right) > CLAUSES * CLAUSES:
        return min(left, right, key=len)
    query = _least(a | b for a in left for b in right)
    return query if len(query) <= CLAUSES else min(left, right, key=len)


def _asked(strings) -> tuple[frozenset[str], ...]:
    """That one of the strings occurs; nothing if one of them is shorter than a trigram."""
    return _either([(frozenset(x[i : i + 3] for i in range(len(x) - 2)),) for x in strings])


@dataclass(frozen=True)
class _Part:
    """What is known of a part of a regex: the strings that it stands for (None: others too, or too many), and a query that all matches fulfil."""

    strings: frozenset[str] | None
    query: tuple[frozenset[str], ...] = ANYTHING


_UNKNOWN, _NOTHING = _Part(None), _Part(frozenset({""}))


def _alternatives(parts: list[_Part]) -> _Part:
    if all(p.strings is not None for p in parts) and len(union := frozenset().union(*(p.strings for p in parts))) <= STRINGS:
        return _Part(union, _asked(union))
    return _Part(None, _either(_asked(p.strings) if p.strings is not None else p.query for p in parts))


def _sequence(parts: list[_Part]) -> _Part:
    """Neighbouring parts of known strings are joined to longer strings; between them stands whatever is unknown."""
    run, whole, query = frozenset({""}), True, ANYTHING
    for p in parts:
        if p.strings is None:
            query, run, whole = _both(_both(query, _asked(run)), p.query), frozenset({""}), False
        elif len(joined := frozenset(a + b for a in run for b in p.strings)) <= STRINGS:
            run = joined
        else:
            query, run, whole = _both(query, _asked(run)), p.strings, False
    query = _both(query, _asked(run))
    return _Part(run if whole else None, query)


def _part(node) -> _Part:
    """One node of a parsed pattern. What isn't listed here stands for anything, so that a match is never ruled out."""
    kind, of = str(node[0]), node[1]
    if kind == "LITERAL":
        return _Part(frozenset({chr(of).lower()})) if 32 <= of < 127 else _UNKNOWN
    if kind == "IN" and all(str(k) == "LITERAL" and 32 <= v < 127 for k, v in of):
        return _alternatives([_part(x) for x in of])
    if kind in ("AT", "ASSERT", "ASSERT_NOT"):  # they match no characters
        return _NOTHING
    if kind in ("SUBPATTERN", "ATOMIC_GROUP"):
        return _sequence([_part(x) for x in (of[3] if kind == "SUBPATTERN" else of)])
    if kind == "BRANCH":
        return _alternatives([_sequence([_part(x) for x in way]) for way in of[1]])
    if kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, body = of[0], of[1], _sequence([_part(x) for x in of[2]])
        if most == 0:
            return _NOTHING
        if (least, most) == (0, 1):
            return _alternatives([body, _NOTHING])
        if least == most and least <= 8:
            return _sequence([body] * least)
        # more than once: the strings stand side by side somehow, each of them whole
        return _Part(None, (_asked(body.strings) if body.strings is not None else body.query) if least else ANYTHING)
    return _UNKNOWN


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """An OR of ANDs of lower-cased trigrams that every match fulfils; None if a way to match has no mandatory trigram.

    The pattern is parsed, and the query follows from its parts by the rules of sequence, alternative and repetition. A pattern that can't be
    parsed, or that Java and Python might read differently, has no query: its rule scans every text."""
    if _DIFFERENT.search(pattern):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")  # a warning tells of what may be read differently
            tree = re._parser.parse(pattern)
    except (re.error, Warning, OverflowError, RecursionError):
        return None
    whole = _sequence([_part(x) for x in tree])
    query = _asked(whole.strings) if whole.strings is not None else whole.query
    return None if not all(query) else sorted(query, key=sorted)


def _vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for r in rules for a in trigram_query(r.pattern) or () for t in a})


def postings(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index: (trigram, id) of each trigram that the rules ask for, for any number of them; rows without id are left out.

    lower() may fold letters beyond A-Z to these too: there are only more candidates."""
    grams = F.array(*map(F.lit, _vocabulary(rules))).cast("array<string>")
    found = bound(F.lower(F.coalesce(F.col(text_col), F.lit(""))), lambda t: F.filter(grams, lambda g: F.contains(t, g)))
    return docs.where(F.col(id_col).isNotNull()).select(F.explode(found).alias("trigram"), F.col(id_col).alias("id"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """(id, asks): the numbers of the rules whose trigram query the postings of an id fulfil; ids without any are left out."""
    ands = [(t, k, c, len(a)) for k, r in enumerate(rules) for c, a in enumerate(trigram_query(r.pattern) or ()) for t in a]
    clauses = index.sparkSession.createDataFrame(ands, "trigram string, rule int, clause int, needs int")  # as many rows as the rules have trigrams
    met = index.join(F.broadcast(clauses), "trigram").groupBy("id", "rule", "clause").agg(F.count("*").alias("n"), F.max("needs").alias("needs"))
    return met.where("n >= needs").groupBy("id").agg(F.collect_set("rule").alias("asks"))


#: Matches whose places are added up at a time; a text's matches cost about this many steps each.
MATCHES = 128


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """All leftmost non-overlapping matches that are long enough, as (start, order, kind, end) in code points, end exclusive.

    Spark's functions give matches and the text between them, not positions: a match starts after the gaps and matches before it. These
    are added up in chunks of MATCHES, the chunks' sums before that, so that the cost grows with the matches and not with their square."""
    kind = "array<struct<start:int,ord:int,kind:string,end:int>>"

    def asked(m: Column) -> Column:
        return F.length(F.regexp_extract(m, rule.pattern, rule.group)) if rule.least else F.length(m)

    def chunk(pieces: Column, start: Column) -> Column:
        def step(acc: Column, p: Column) -> Column:
            at = acc["at"] + p["gap"]
            span = F.struct(at.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), (at + p["found"]).alias("end"))
            spans = F.when(p["asked"] >= rule.least, F.array_append(acc["spans"], span)).otherwise(acc["spans"])
            return F.struct((at + p["found"]).alias("at"), spans.alias("spans"))

        return F.aggregate(pieces, F.struct(start.alias("at"), F.array().cast(kind).alias("spans")), step, lambda a: a["spans"])

    def placed(pieces: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(pieces) / MATCHES).cast("int") - 1), lambda i: F.slice(pieces, i * MATCHES + 1, F.lit(MATCHES)))
        sums = lambda parts: F.transform(parts, lambda c: F.aggregate(c, F.lit(0), lambda acc, p: acc + p["gap"] + p["found"]))
        before = lambda totals: F.aggregate(totals, F.array(F.lit(0)), lambda acc, t: F.array_append(acc, F.element_at(acc, -1) + t))
        both = lambda parts: F.arrays_zip(parts.alias("part"), F.slice(before(sums(parts)), F.lit(1), F.size(parts)).alias("start"))
        return bound(chunks, lambda parts: F.flatten(F.transform(both(parts), lambda x: chunk(x["part"], x["start"]))))

    def between(found: Column) -> Column:
        gaps = F.slice(F.transform(F.split(text, rule.pattern, -1), F.length), F.lit(1), F.size(found))
        sizes, long = F.transform(found, F.length), F.transform(found, asked)
        pieces = F.arrays_zip(gaps.alias("gap"), sizes.alias("found"), long.alias("asked"))
        return F.when(F.size(found) > 0, bound(pieces, placed)).otherwise(F.array().cast(kind))

    return bound(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), between)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, text_col: str = "text", out: str = "secrets", id_col: str = "doc_id") -> DataFrame:
    """docs with `out` added (replaced if there): array of (start, ord, kind, end), ordered by start, then by the rules' order.

    Null and empty texts give an empty array. Rows that repeat stay; rows of one id are verified if any of them is a candidate, rows without
    id always. Only rows whose id may be a candidate are shuffled, to meet the candidates; a broadcast table of at most 2 ** 20
    digests of ids tells. Any number of matches in a text and of trigrams in the rules will do. An empty table gives no rows."""
    docs = docs.drop(out)
    asks, by = fresh(docs, "_asks", "_asked_id")
    found = written(candidates(written(postings(docs, rules, id_col, text_col)), rules).select(F.col("id").alias(by), F.col("asks").alias(asks)))
    maybe, apart = split_by_ids(docs, found.select(F.col(by).alias(id_col)), id_col)
    met = maybe.join(found.hint("merge"), F.col(id_col) == F.col(by), "left").drop(by)
    rows = apart.withColumn(asks, F.lit(None).cast("array<int>")).unionByName(met)
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>")
    spans = []
    for k, r in enumerate(rules):
        hit = F.lit(True) if trigram_query(r.pattern) is None else F.coalesce(F.array_contains(asks, k), F.lit(False)) | F.col(id_col).isNull()
        spans.append(F.when(hit, _spans(text, r, k)).otherwise(none))
    return rows.withColumn(out, F.array_sort(F.concat(*spans))).drop(asks)


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, text_col: str = "text", mark: str = "[secret]", id_col: str = "doc_id") -> DataFrame:
    """docs with each found span (for `assign`: keyword and value) replaced by mark; spans that overlap become one mark. Texts without secrets
    stay as they are, null and empty ones too; columns keep their order. An empty table gives no rows."""
    name = fresh(docs, "_found")[0]
    spans, text = F.col(name), F.col(text_col)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, s: Column) -> Column:
        new = F.array_append(acc["done"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], new).otherwise(acc["done"]).alias("done"))

    clean = F.aggregate(spans, zero, step, lambda a: F.concat(F.array_join(a["done"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    found = scan_secrets(docs, rules, text_col, name, id_col)
    return found.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(text)).select(*docs.columns)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The secrets of every document. Edge cases as in scan_secrets; a null text counts as empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs).select("doc_id", "secrets")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["ord"] < len(BASE))
    return found.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))


def _sql_spans(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT k, {order} AS ord, '{kind}' AS kind, s + g AS start, s + g + m AS stop FROM (
    SELECT k, i, unnest(gaps) AS g, unnest(found) AS m, unnest(asked) AS a,
      unnest(list_transform(range(len(found)), lambda j: coalesce(list_sum(gaps[1:j]), 0) + coalesce(list_sum(found[1:j]), 0))) AS s
    FROM (
      SELECT k, 0 AS i, list_transform(regexp_split_to_array(text, '{quoted}'), lambda x: length(x)) AS gaps0,
        list_transform(regexp_extract_all(text, '{quoted}', 0), lambda x: length(x)) AS found,
        list_transform(regexp_extract_all(text, '{quoted}', {group}), lambda x: length(x)) AS asked,
        gaps0[1:len(found)] AS gaps
      FROM d WHERE regexp_matches(text, '{quoted}'))) WHERE a >= {least}"""


OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(_sql_spans(r.kind, k, r.pattern, r.group, r.least) for k, r in enumerate(BASE + ADDED))}),
j AS (
  SELECT k, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (ord < 3) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans
  FROM s GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (k)
"""
