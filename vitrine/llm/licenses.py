"""License scans with a positional index of rare words, in DataFrame functions alone.

Document frequencies of all template words are counted over all documents; each template is
then looked up by its rarest words (highest IDF).  Positions of those words in a text, less
their offsets in the template, are the starts they vote for; the starts that all of them
agree on are the intersection of their postings.  A start counts if the template's mandatory
key phrase stands there word for word, and scores the share of the template's words found at
their places.  Everything after the count of frequencies is local to a row: no shuffle, so no
hot word or file.

Words are runs of digits, a-z (A-Z lower-cased) and non-ASCII characters.  Null and empty
texts have no words, no labels, null places and score 0.  Repeated rows repeat their result.
The input's columns are kept; one named as a result or helper is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from vitrine.llm.decontaminate import LOWER, UPPER, WORD

RARE = 3
RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    key: str = ""  # mandatory phrase at the start of the words; all of them if empty
    base: bool = False

    @property
    def listed(self) -> list[str]:
        return self.words.split(" ")

    @property
    def mandatory(self) -> list[str]:
        return (self.key or self.words).split(" ")


# License phrases and their labels.
TEMPLATES = [
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
    Template("gpl-2.0", "gnu general public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("apache-2.0", "apache license version 2 0"),
    Template("cc-by-4.0", "cc by 4 0"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-nc-4.0", "cc by nc 4 0"),
    Template("cc0", "cc0 1 0"),
    Template("mpl-2.0", "mozilla public license version 2 0", "mozilla public license"),
    Template(
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
        "permission is hereby granted free of charge",
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
        "redistribution and use in source and binary forms",
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "permission to use copy modify and or distribute",
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        "this is free and unencumbered software",
    ),
]


def words_of(text: str) -> Column:
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def document_frequencies(docs: DataFrame, templates: list[Template] = TEMPLATES, text: str = "text") -> dict[str, int]:
    """Documents holding each template word; as many rows as the templates have words reach the driver."""
    vocabulary = sorted({w for t in templates for w in t.listed})
    known = F.array(*[F.lit(w) for w in vocabulary])
    found = docs.select(F.explode(F.array_intersect(words_of(text), known)).alias("word"))
    return {**dict.fromkeys(vocabulary, 0), **{r.word: r["count"] for r in found.groupBy("word").count().collect()}}


def rare_words(template: Template, frequency: dict[str, int], n: int = RARE) -> list[tuple[str, int]]:
    """(word, offset) of the mandatory phrase's rarest words; ties by offset."""
    offsets: dict[str, int] = {}
    for at, word in enumerate(template.mandatory):
        offsets.setdefault(word, at)
    return sorted(offsets.items(), key=lambda x: (frequency.get(x[0], 0), x[1]))[:n]


def _votes(places: Column, word: str, offset: int) -> Column:
    """The starts that the places of one word stand for."""
    return F.transform(F.filter(places, lambda p: p["word"] == word), lambda p: p["at"] - F.lit(offset))


def _starts(template: Template, rare: list[tuple[str, int]], places: Column) -> Column:
    """Word positions where the template's key phrase stands."""
    votes = [_votes(places, word, offset) for word, offset in rare]
    agreed = votes[0]
    for vote in votes[1:]:
        agreed = F.array_intersect(agreed, vote)
    key = template.mandatory
    phrase = F.array(*[F.lit(w) for w in key])
    return F.filter(
        agreed, lambda s: (s >= 0) & (F.slice("_words", F.greatest(s, F.lit(0)) + 1, F.lit(len(key))) == phrase)
    )


def _share(template: Template, start: Column) -> Column:
    """The share of the template's words that stand at their places."""
    listed = template.listed
    hits = [F.when(F.get("_words", start + F.lit(i)) == w, 1).otherwise(0) for i, w in enumerate(listed)]
    return sum(hits[1:], hits[0]) / F.lit(float(len(listed)))


def _best_share(template: Template, starts: str) -> Column:
    return F.array_max(F.transform(F.col(starts), lambda start: _share(template, start)))


def scan(
    docs: DataFrame, templates: list[Template] = TEMPLATES, text: str = "text", frequency: dict[str, int] | None = None
) -> DataFrame:
    """Every row with ``RESULTS``."""
    docs = docs.drop(*RESULTS, "_words", "_places", *[f"_t{i}" for i in range(len(templates))])
    if frequency is None:
        frequency = document_frequencies(docs, templates, text)
    chosen = {t: rare_words(t, frequency) for t in templates}
    looked_up = sorted({word for rare in chosen.values() for word, _ in rare})
    known = F.array(*[F.lit(w) for w in looked_up])
    # a text without any template's rarest word needs no look-up
    rarest = F.array(*[F.lit(w) for w in sorted({rare[0][0] for rare in chosen.values()})])
    indexed = F.filter(
        F.transform("_words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))),
        lambda p: F.array_contains(known, p["word"]),
    )
    kept = docs.columns
    rows = docs.withColumn("_words", words_of(text))
    rows = rows.withColumn("_places", F.when(F.arrays_overlap("_words", rarest), indexed))
    names = [f"_t{i}" for i in range(len(templates))]
    empty = F.array().cast("array<int>")
    rows = rows.select(
        *kept,
        "_words",
        *[
            F.when(F.col("_places").isNull(), empty).otherwise(_starts(t, chosen[t], F.col("_places"))).alias(name)
            for t, name in zip(templates, names)
        ],
    )
    base = [(t, n) for t, n in zip(templates, names) if t.base]
    all_base = F.concat(*[F.col(n) for _, n in base])

    def labels(pairs):
        return F.array_join(
            F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(n) > 0, F.lit(t.label)) for t, n in pairs])))), ","
        )

    scores = [F.coalesce(_best_share(t, n), F.lit(0.0)) for t, n in zip(templates, names)]
    return rows.select(
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        F.size(all_base).cast("long").alias("n_base"),
        F.array_min(all_base).cast("long").alias("first_word"),
        F.array_max(all_base).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(list(zip(templates, names))).alias("labels"),
        F.greatest(*scores).alias("score"),
    )


def oracle(templates: list[Template] = TEMPLATES) -> str:
    """The same in DuckDB, without an index: every start of a key phrase, found by comparing words."""
    values = ", ".join(
        f"('{t.label}', {t.base}, string_split('{t.words}', ' '), string_split('{' '.join(t.mandatory)}', ' '))" for t in templates
    )
    return f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents),
t(label, base, listed, must) AS (VALUES {values}),
firsts AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS pos FROM w),
hits AS (
  SELECT doc_id, pos, label, base,
    len(list_filter(range(1, len(listed) + 1), lambda i: coalesce(words[pos + i - 1] = listed[i], false))) / CAST(len(listed) AS DOUBLE) AS share
  FROM firsts JOIN t ON words[pos] = must[1] AND list_slice(words, pos, pos + len(must) - 1) = must),
found AS (
  SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(pos - 1) FILTER (WHERE base) AS first_word,
    max(pos - 1) FILTER (WHERE base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM w LEFT JOIN found USING (doc_id)"""
