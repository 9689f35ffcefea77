"""License scans with a positional rare-token index, in DataFrame functions only.

Templates are word sequences with mandatory key phrases. The index lists, for each template, its rarest word in the
scanned corpus (highest inverse document frequency) with its place in the template. A file's words are looked up
there; each hit proposes a start of the template, postings of the template's other words are intersected by their
relative positions, and the places where the whole phrase stands are verified. One small aggregate counts document
frequencies; the scan itself is a single narrow projection.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words once A-Z are lower-cased.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Base phrases with their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Labels of the method's own: further key phrases of public licence texts.
OWN = (
    ("redistribution and use in source and binary forms", "bsd"),
    ("bsd license", "bsd"),
    ("permission is hereby granted free of charge", "mit"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("creative commons attribution", "cc-by"),
    ("licensed under the apache license", "apache"),
    ("spdx license identifier", "spdx"),
    ("all rights reserved", "proprietary"),
)


@dataclass(frozen=True)
class Template:
    phrase: tuple[str, ...]
    label: str
    base: bool


def templates(base=BASE, own=OWN) -> list[Template]:
    return [Template(tuple(p.split()), label, kind) for kind, group in ((True, base), (False, own)) for p, label in group]


def words(text: Column) -> Column:
    """Words of a text; null counts as empty."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def document_frequency(df: DataFrame, vocabulary: list[str], text: str = "text") -> tuple[int, dict[str, int]]:
    """Rows in all, and rows that hold each licence word. Only the vocabulary's counts reach the driver."""
    known = F.array_intersect(words(F.col(text)), F.array(*map(F.lit, vocabulary)))
    flags = df.select(known.alias("w")).select(*(F.array_contains("w", w).cast("long").alias(f"w{k}") for k, w in enumerate(vocabulary)))
    row = flags.agg(F.count("*").alias("n"), *(F.sum(f"w{k}").alias(f"w{k}") for k in range(len(vocabulary)))).first()
    return row["n"], {w: row[f"w{k}"] or 0 for k, w in enumerate(vocabulary)}


def scan(df: DataFrame, kinds: list[Template] | None = None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns of ``keep`` plus ``n_words long``, ``places array<struct<start int, kind int>>`` (verified places, by
    start) and ``score double``: the largest share of a template's IDF mass that stands at the right relative
    positions around one of its rarest words, 1 where a whole phrase does and 0 without any.

    Null and empty texts have no words and no places. Rows map one to one; repeated rows and ties stay; columns of
    other names are not read. An empty table gives no rows.
    """
    kinds = templates() if kinds is None else kinds
    vocabulary = sorted({w for t in kinds for w in t.phrase})
    n, df_of = document_frequency(df, vocabulary, text)
    idf = {w: math.log((1 + n) / (1 + df_of[w])) + 1 for w in vocabulary}
    anchors: dict[str, list[tuple[int, int]]] = {}
    for k, t in enumerate(kinds):
        at = max(range(len(t.phrase)), key=lambda i: (idf[t.phrase[i]], -i))
        anchors.setdefault(t.phrase[at], []).append((k, at))
    rare = F.array(*map(F.lit, sorted(anchors)))

    base = df.select(*keep, words(F.col(text)).alias("__w"))
    base = base.withColumn("__hit", F.arrays_overlap("__w", rare))
    # places of rare words in the file, only where there are any
    spots = F.filter(F.sequence(F.lit(1), F.size("__w")), lambda i: F.array_contains(rare, F.element_at(F.col("__w"), i)))
    base = base.withColumn("__spots", F.when(F.col("__hit"), spots).otherwise(F.array().cast("array<int>")))

    def proposed(k: int, t: Template) -> Column:
        """Starts (from 0) and IDF share of one template, from its rare word's places."""
        at = next(i for w in anchors for j, i in anchors[w] if j == k)
        mass = sum(idf[w] for w in t.phrase)
        share = lambda i: sum((F.when(F.get(F.col("__w"), i - 1 - at + j) == w, F.lit(idf[w] / mass)).otherwise(F.lit(0.0)) for j, w in enumerate(t.phrase)), F.lit(0.0))
        mine = F.filter(F.col("__spots"), lambda i: F.element_at(F.col("__w"), i) == t.phrase[at])
        verified = lambda i: F.slice(F.col("__w"), F.greatest(i - at, F.lit(1)), len(t.phrase)) == F.array(*map(F.lit, t.phrase))
        return F.transform(mine, lambda i: F.struct((i - 1 - at).alias("start"), F.lit(k).alias("kind"), ((i - 1 - at >= 0) & verified(i)).alias("whole"), share(i).alias("share")))

    found = F.when(F.col("__hit"), F.concat(*(proposed(k, t) for k, t in enumerate(kinds)))).otherwise(F.array().cast("array<struct<start:int,kind:int,whole:boolean,share:double>>"))
    base = base.withColumn("__found", found)
    best = F.aggregate("__found", F.lit(0.0), lambda a, x: F.greatest(a, F.when(x["whole"], F.lit(1.0)).otherwise(F.least(x["share"], F.lit(0.99)))))
    places = F.array_sort(F.transform(F.filter("__found", lambda x: x["whole"]), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"))))
    return base.select(*keep, F.size("__w").cast("long").alias("n_words"), places.alias("places"), best.alias("score"))


def license_scan(df: DataFrame) -> DataFrame:
    """The digest of op3."""
    kinds = templates()
    label = F.array(*(F.lit(t.label) for t in kinds))
    n_base = sum(t.base for t in kinds)
    found = scan(df, kinds).withColumn("__base", F.filter("places", lambda x: x["kind"] < n_base))
    starts = F.transform("__base", lambda x: x["start"].cast("long"))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: F.get(label, x["kind"])))), ",")
    return found.select(
        "doc_id", "n_words", F.size("__base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined("__base").alias("base_labels"), joined("places").alias("labels"), "score"
    )


def oracle() -> str:
    """DuckDB SQL for the digest."""
    kinds = templates()
    n_base = sum(t.base for t in kinds)
    vocabulary = sorted({w for t in kinds for w in t.phrase})
    text = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {text(t.label)}, [{', '.join(map(text, t.phrase))}])" for k, t in enumerate(kinds))
    return f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
tp(kind, label, phrase) AS (VALUES {rows}),
voc AS (SELECT DISTINCT unnest(phrase) AS word FROM tp),
total AS (SELECT count(*) AS n FROM d),
freq AS (SELECT word, ln((1 + (SELECT n FROM total)) / (1.0::double + coalesce(c, 0))) + 1 AS idf FROM voc LEFT JOIN
  (SELECT word, count(*) AS c FROM (SELECT DISTINCT doc_id, unnest(list_intersect(w, [{', '.join(map(text, vocabulary))}])) AS word FROM d) GROUP BY word) USING (word)),
pw AS (SELECT kind, label, phrase, unnest(phrase) AS word, unnest(range(len(phrase))) AS j FROM tp),
pi AS (SELECT pw.*, idf FROM pw JOIN freq USING (word)),
mass AS (SELECT kind, sum(idf) AS mass FROM pi GROUP BY kind),
anchor AS (SELECT kind, label, phrase, word, j FROM pi QUALIFY row_number() OVER (PARTITION BY kind ORDER BY idf DESC, j) = 1),
pos AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
prop AS (SELECT DISTINCT doc_id, kind, label, phrase, i - j AS start FROM pos JOIN anchor USING (word)),
hit AS (SELECT prop.doc_id, prop.kind, prop.label, prop.start, sum(CASE WHEN pos.word IS NOT NULL THEN pi.idf ELSE 0 END) / any_value(mass.mass) AS share, count(pos.word) = any_value(len(prop.phrase)) AS whole
  FROM prop JOIN pi ON pi.kind = prop.kind JOIN mass ON mass.kind = prop.kind LEFT JOIN pos ON pos.doc_id = prop.doc_id AND pos.i = prop.start + pi.j AND pos.word = pi.word GROUP BY ALL),
agg AS (SELECT doc_id, count(*) FILTER (whole AND kind < {n_base}) AS n_base, min(start) FILTER (whole AND kind < {n_base}) AS first_word, max(start) FILTER (whole AND kind < {n_base}) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole AND kind < {n_base}) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole) AS labels,
  max(CASE WHEN whole THEN 1.0 ELSE least(share, 0.99) END) AS score FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0)::DOUBLE, 9) AS score
FROM d LEFT JOIN agg USING (doc_id)"""
