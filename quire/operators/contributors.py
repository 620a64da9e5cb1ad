"""Contributors in running text: bylines and credits by pattern tables, roles by scored context, de-duplicated spans and names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]*)*\s+[A-Z][a-z]+)"
# Byline and credit patterns with the confidence of each.
BYLINES = [
    ("by_simple", rf"(?:^|\s)[Bb]y\s+{NAME}", 0.95), ("by_with_title", rf"(?m)(?:^|\s)[Bb]y\s+{NAME},\s*[^\n]+$", 0.93), ("by_multiple", rf"[Bb]y\s+{NAME}\s+and\s+[A-Z]", 0.90), ("by_comma_separated", rf"[Bb]y\s+{NAME},\s*[A-Z]", 0.88),
    ("reporter", rf"{NAME}\s*,?\s*(?:reports?|correspondent|staff\s+writer)", 0.85), ("correspondent", rf"{NAME}\s*,?\s*(?:correspondent|reporter)", 0.87), ("from_location", rf"From\s+{NAME}\s+in\s+[A-Z][a-z]+", 0.82), ("dateline", rf"[A-Z][A-Z\s]+\s*[-–—]\s*{NAME}", 0.75),
    ("author_suffix", rf"Author:\s*{NAME}", 0.90), ("written_by", rf"[Ww]ritten\s+by\s+{NAME}", 0.92), ("name_title", rf"{NAME}\s*,\s*[^\n]+?(?:for|at|of)\s+[A-Z][a-z]", 0.80), ("contributing", rf"{NAME}\s*(?:contributed|contributing)\s+(?:to\s+this\s+report|reporting)", 0.78),
]
CREDITS = [
    ("photo_credit", rf"(?:Photo|Image|Picture)\s*(?:by|credit|courtesy)?:?\s*{NAME}", 0.92), ("photo_by", rf"Photo\s+by\s+{NAME}", 0.95), ("photography", rf"Photography\s*:?\s*{NAME}", 0.90), ("photographer", rf"Photographer\s*:?\s*{NAME}", 0.93), ("illustration", rf"Illustration\s*(?:by)?\s*:?\s*{NAME}", 0.90),
    ("illustrator", rf"Illustrator\s*:?\s*{NAME}", 0.93), ("graphic_by", rf"Graphic\s+by\s+{NAME}", 0.88), ("credit_colon", rf"Credit\s*:?\s*{NAME}", 0.75), ("courtesy", rf"Courtesy\s+(?:of\s+)?{NAME}", 0.70), ("source", rf"Source\s*:?\s*{NAME}", 0.65),
]
TITLE_WORDS = ["editor", "reporter", "correspondent", "writer", "journalist", "photographer", "staff", "bureau", "chief", "senior", "associate"]
AGENCIES = ["ap", "reuters", "getty", "afp", "shutterstock", "stock", "news", "press", "agency", "service", "media", "photo", "images", "pictures", "wire", "bureau"]
# Per role, (weight, pattern of a category), and its keywords.
ROLES = {
    "author": ([(1.0, r"\bby\s+[a-z]|\bwritten\s+by\b|\breport(?:er|ed)\b|\bcorrespondent\b|\bcolumnist\b|\bstaff\s+writer\b"), (0.8, r"^\s*by\s+|--\s*|:\s*"), (0.9, r"\b(?:senior|staff|special|associate|contributing|guest)\s+(?:writer|correspondent|editor|reporter|columnist)\b")], ["by", "writer", "author", "reporter", "correspondent", "columnist"]),
    "photographer": ([(1.0, r"\b(?:photo(?:graph)?|picture|image)\s*(?:by|credit|courtesy)\b|\b(?:shot|captured)\s*by\b|\bphotographer\b"), (0.8, r"[(\[]photo\s*(?:by|credit)|(?:photo\s*credit|image\s*(?:courtesy|credit))\s*(?:of|:)"), (0.9, r"\b(?:staff|senior|freelance|contributing)\s+photographer\b|\bphoto\s+editor\b")], ["photo", "photograph", "image", "picture", "shot", "photographer"]),
    "illustrator": ([(1.0, r"\b(?:illustration|drawing|artwork|graphic|design)\s*(?:by|credit)\b|\billustrator\b"), (0.8, r"[(\[](?:illustration|graphic)\s*(?:by|credit)|(?:illustration\s*credit|artwork\s*(?:courtesy|credit))\s*(?:of|:)"), (0.9, r"\b(?:staff|senior|freelance)\s+illustrator\b|\bgraphic\s+(?:designer|artist)\b|\bart\s+director\b")], ["illustration", "drawing", "artwork", "graphic", "design", "illustrator"]),
    "editor": ([(1.0, r"\bedited\s+by\b|\beditor\b|\beditorial\s+(?:by|credit)\b")], ["editor", "edited", "editorial"]),
}


def matches(texts: DataFrame, patterns: list[tuple[str, str, float]], credit: bool = False) -> DataFrame:
    """texts(id, text) to one row per match: pattern, match, name and confidence; the pattern table is applied in the JVM."""

    def hits(label: str, pattern: str, base: float) -> Column:
        whole, person = F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
        return F.zip_with(whole, person, lambda m, p: F.struct(F.lit(label).alias("pattern"), F.trim(m).alias("match"), p.alias("name"), F.lit(base).alias("base")))

    found = [hits(*row) for row in patterns]
    rows = texts.select("id", F.explode(F.flatten(F.array(*found))).alias("m")).select("id", "m.*")
    n = F.size(F.split("match", r"\s+"))
    bonus = F.when(F.lower("match").contains("by") if credit else F.col("match").startswith("By "), 0.05).otherwise(0.0) + F.when(n <= (4 if credit else 3), 0.03).otherwise(0.0)
    valid = is_credit_name(F.col("name")) if credit else is_likely_name(F.col("name"))
    return rows.filter(valid).select("id", "pattern", "match", "name", F.least(F.lit(1.0), F.col("base") + bonus).alias("confidence"))


def is_likely_name(name: Column) -> Column:
    w = F.split(F.lower(F.trim(name)), r"\s+")
    return name.rlike(r"^[A-Za-z][A-Za-z\s.'\-]+$") & (F.size(w) <= 5) & ~F.arrays_overlap(w, F.array(*map(F.lit, TITLE_WORDS)))


def is_credit_name(name: Column) -> Column:
    low, agency = F.lower(name), F.lit(False)
    for word in AGENCIES:
        agency = agency | low.contains(word)
    return name.rlike(r"^[A-Za-z][A-Za-z\s.'\-]+$") & ~agency & F.size(F.split(F.trim(name), r"\s+")).between(1, 4)


def best_matches(found: DataFrame) -> DataFrame:
    """One match per text and name: the surest, then the first pattern by name."""
    best = F.max_by(F.struct("pattern", "match", "confidence"), F.struct("confidence", "pattern"))
    return found.groupBy("id", "name").agg(best.alias("b")).select("id", "name", "b.*")


def role_scores(context: Column) -> Column:
    """Array of (score, role) of a context, by matched categories and keywords."""
    low = F.lower(context)
    words = F.array_distinct(F.regexp_extract_all(low, F.lit(r"[a-z]+"), F.lit(0)))
    out = []
    for role, (categories, keywords) in ROLES.items():
        total = sum((F.when(low.rlike(p), w).otherwise(0.0) for w, p in categories), F.lit(0.0)) / sum(w for w, _ in categories)
        boost = F.least(F.lit(0.2), F.size(F.array_intersect(words, F.array(*map(F.lit, keywords)))) / len(keywords) * 0.2)
        out.append(F.struct(F.least(F.lit(1.0), total + boost).alias("score"), F.lit(role).alias("role")))
    return F.array(*out)


def classify_role(context: Column, least: float = 0.3) -> Column:
    """(role, confidence): the best role, unknown below the least, at 0.8 where the next is within 0.1."""
    ranked = F.reverse(F.array_sort(role_scores(context)))
    best, next_ = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    sure = best["score"] * F.when(best["score"] - next_["score"] < 0.1, 0.8).otherwise(1.0)
    return F.struct(F.when(best["score"] < least, "unknown").otherwise(best["role"]).alias("role"), F.when(best["score"] < least, best["score"]).otherwise(sure).alias("confidence"))


def deduplicate_spans(spans: DataFrame) -> DataFrame:
    """spans(id, start, stop, confidence, label): greedy from the left; of two that overlap the surer stays. Ids pass by in order, so
    a worker holds the spans kept of one id."""
    names = spans.columns
    id_, start, stop, sure = (names.index(c) for c in ("id", "start", "stop", "confidence"))

    def overlap(x: tuple, y: tuple) -> bool:
        return None not in (x[start], x[stop], y[start], y[stop]) and x[start] < y[stop] and x[stop] > y[start]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, kept = None, []
        for batch in batches:
            schema, done = batch.schema, []
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kept and kept[0][id_] != x[id_]:
                    done += kept
                    kept = []
                clash = next((k for k, y in enumerate(kept) if overlap(x, y)), None)
                if clash is None:
                    kept.append(x)
                elif x[sure] is not None and (kept[clash][sure] is None or x[sure] > kept[clash][sure]):
                    del kept[clash]
                    kept.append(x)
            yield _batch(done, schema)
        if kept:
            yield _batch(kept, schema)

    order = [F.col(c).asc_nulls_last() for c in ("id", "start", "stop", "label")]
    return spans.repartition("id").sortWithinPartitions(*order).mapInArrow(keep, spans.schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def deduplicate_names(people: DataFrame, alike: float = 0.8) -> DataFrame:
    """people(id, name, confidence): per id, names that are equal, contain each other or share most words count once, the surest
    stays."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for x in pdf.sort_values(["name", "confidence"]).itertuples(index=False):
            a = x.name.lower()

            def same(y: tuple, a: str = a) -> bool:
                b = y.name.lower()
                p, q = set(a.split()), set(b.split())
                return a == b or a in b or b in a or bool(p and q and len(p & q) / len(p | q) >= alike)

            twin = next((y for y in kept if same(y)), None)
            if twin is None:
                kept.append(x)
            elif x.confidence > twin.confidence:
                kept.remove(twin)
                kept.append(x)
        return pd.DataFrame(kept, columns=pdf.columns)

    return people.groupBy("id").applyInPandas(keep, people.schema)


def quality_label(people: DataFrame) -> DataFrame:
    """high, medium or low per id, by mean confidence and the share of sure contributors."""
    mean, share = F.avg("confidence"), F.avg(F.when(F.col("confidence") >= 0.9, 1.0).otherwise(0.0))
    return people.groupBy("id").agg(mean.alias("mean"), share.alias("share"), F.when((mean >= 0.9) & (share >= 0.8), "high").when((mean >= 0.7) & (share >= 0.6), "medium").otherwise("low").alias("quality"))


def split_authors(byline: Column) -> Column:
    """The names of a byline with several authors, parted by commas, ampersands or "and"."""
    names = F.split(F.regexp_replace(F.trim(byline), r"(?i)^by\s+", ""), r"\s*(?:,|&|\band\b)\s*")
    return F.filter(names, lambda n: n.rlike(r"^[A-Z][a-zA-Z'.-]+(?: [A-Z][a-zA-Z'.-]+)+$"))


def accepted(people: DataFrame, extraction: float = 0.8, role: float = 0.7, name: float = 0.8) -> DataFrame:
    """people(id, name, confidence, role_confidence, name_confidence) that reach all three thresholds."""
    return people.filter((F.col("confidence") >= extraction) & (F.col("role_confidence") >= role) & (F.col("name_confidence") >= name))


def combined(matches: DataFrame) -> DataFrame:
    """matches(id, start, stop, method, confidence, name) of patterns and of a tagger: where two share over half of the shorter one, the
    one of the better method stays (pattern before ner), then the surer, then the earlier; taken from the best match on, so that the
    result doesn't depend on the order of the input."""
    rank = F.when(F.col("method") == "pattern", 0).otherwise(1)
    fields = F.struct(rank.alias("rank"), (-F.col("confidence")).alias("unsure"), "start", "stop", "name", "method", "confidence")
    best_first = F.array_sort(F.collect_list(fields))

    def shared(x: Column, y: Column) -> Column:
        length = F.least(x["stop"] - x["start"], y["stop"] - y["start"])
        return F.least(x["stop"], y["stop"]) - F.greatest(x["start"], y["start"]) > 0.5 * length

    take = lambda kept, x: F.when(F.exists(kept, lambda y: shared(x, y)), kept).otherwise(F.concat(kept, F.array(x)))
    rows = matches.groupBy("id").agg(best_first.alias("all"))
    rows = rows.select("id", F.explode(F.aggregate("all", F.slice("all", 1, 0), take)).alias("m"))
    return rows.select("id", "m.start", "m.stop", "m.method", "m.confidence", "m.name")
