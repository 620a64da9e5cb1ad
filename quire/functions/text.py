"""Text predicates, normalisers and scores as Column expressions; regular expressions stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Minor words of titles, phrases of advertisements, words that mark captions and continuations.
MINOR = ["a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with"]
ADS = ["advertisement", "sponsored", "subscribe", "buy now", "call now", "visit our website", "www.", "offer expires", "limited time"]
CAPTION_WORDS = ["photo", "image", "picture", "figure", "caption", "credit", "courtesy", "source", "by ", "photographer", "illustration"]
CONTINUATIONS = [
    r"continued?\s+on\s+page\s+(\d+)", r"see\s+page\s+(\d+)", r"turn\s+to\s+page\s+(\d+)", r"continued?\s+(?:on\s+)?p\.?\s*(\d+)", r"from\s+page\s+(\d+)",
    r"continued?\s+from\s+p\.?\s*(\d+)", r"\(continued?\)", r"\(cont\.?\)", r"more\s+on\s+page\s+(\d+)",
]
#: Latin letters whose compatibility decomposition is one letter and marks, for accent folding by translate().
_FOLDS = [(c, d[0]) for c in map(chr, range(0xC0, 0x250)) if len(d := unicodedata.normalize("NFKD", c)) > 1 and all(unicodedata.combining(x) for x in d[1:])]


def folded(text: Column) -> Column:
    """Accents taken off Latin letters."""
    return F.translate(text, "".join(c for c, _ in _FOLDS), "".join(d for _, d in _FOLDS))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def words(text: Column) -> Column:
    """The parts between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def normalised_title(text: Column) -> Column:
    """Accents folded, lower case, single blanks, only word characters, apostrophes and hyphens, four forms of address spelt out."""
    t = F.regexp_replace(squeezed(F.lower(folded(F.coalesce(text, F.lit(""))))), r"[^\p{L}\p{N}_\s'-]", "")
    for short, long in (("dr", "doctor"), ("mr", "mister"), ("ms", "miss"), ("prof", "professor")):
        t = F.regexp_replace(t, rf"\b{short}\b", long)
    return t


def body_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(folded(F.coalesce(text, F.lit("")))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def normalised_name(text: Column) -> Column:
    """Title case (also after apostrophes), single blanks, dots after abbreviations."""
    parts = F.split(F.initcap(F.lower(squeezed(folded(F.coalesce(text, F.lit("")))))), "'")
    t = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1000))), "'")
    for short in ("Dr", "Mr", "Ms", "Prof", "Jr", "Sr"):
        t = F.regexp_replace(t, rf"\b{short}\b\.?", f"{short}.")
    return t


def ocr_normalised(text: Column, punctuation: str = "ignore") -> Column:
    """Lower case, single blanks; punctuation dropped (ignore), quotes and dashes unified (normalize), or kept (strict)."""
    t = F.lower(F.coalesce(text, F.lit("")))
    if punctuation == "ignore":
        t = F.regexp_replace(t, r"[^\p{L}\p{N}_\s]", " ")
    elif punctuation == "normalize":
        t = F.regexp_replace(F.regexp_replace(t, "[“”„]", '"'), "[–—]", "-")
    return squeezed(t)


def is_page_number(text: Column) -> Column:
    t = F.trim(text)
    return t.rlike(r"^\d+$") | t.rlike(r"(?i)^page\s+\d+$") | t.rlike(r"^\d+\s*/\s*\d+$") | (t.rlike(r"(?i)^[ivxlcdm]+$") & (F.length(t) <= 6))


def is_content(text: Column) -> Column:
    low = F.lower(text)
    return (F.size(words(text)) > 20) | low.rlike(r"\b(article|story|report|analysis|interview)\b|\b(said|according to|reported|stated)\b|\b(however|therefore|furthermore|moreover)\b")


def is_byline(text: Column) -> Column:
    low = F.lower(text)
    return low.rlike(r"^by\s+[a-z]+(?:\s+[a-z]+)*$") | low.rlike(r"\b(?:reports?|correspondent|editor)\b") | low.rlike(r"^author:\s*[a-z]+") | text.rlike(r"^[A-Z][a-z]+\s+[A-Z][a-z]+,?\s+(?:reports?|correspondent)")


def is_caption(text: Column, font: Column) -> Column:
    marked = text.rlike(r"(?i)^(?:photo|image|figure|chart):") | text.rlike(r"(?i)(?:photo|courtesy|credit):\s*")
    return F.coalesce((font != 0) & (font < 10), F.lit(False)) | ((F.size(words(text)) <= 30) & marked)


def is_quote(text: Column) -> Column:
    wrapped = lambda q: text.startswith(q) & text.endswith(q)
    return wrapped('"') | wrapped("'") | ((F.size(words(text)) <= 50) & text.contains('"'))


def is_advertisement(text: Column) -> Column:
    low, out = F.lower(text), F.lit(False)
    for phrase in ADS:
        out = out | low.contains(phrase)
    return out


def title_case_ratio(text: Column) -> Column:
    """Share of words cased as in a title; minor words count a half if lower-cased; below two words 0."""
    w = words(text)
    upper = lambda x: F.substring(x, 1, 1).rlike(r"\p{Lu}")
    minor = lambda x: F.regexp_replace(F.lower(x), "[^a-z]", "").isin(MINOR)
    score = lambda x, i: F.when(i == 0, F.when(upper(x), 1.0).otherwise(0.0)).when(~minor(x) & upper(x), 1.0).when(minor(x) & ~upper(x), 0.5).otherwise(0.0)
    total = F.aggregate(F.transform(w, score), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(w) < 2, 0.0).otherwise(total / F.size(w))


def has_title_case(text: Column) -> Column:
    return title_case_ratio(text) >= 0.6


def continuation_markers(text: Column) -> Column:
    """Array of (pattern, marker, type, target page, confidence) of the marks that send a reader on or back."""
    low = F.lower(text)
    found = []
    for k, pattern in enumerate(CONTINUATIONS):
        group = 1 if "(\\d+)" in pattern else 0
        hit = F.regexp_extract_all(low, F.lit(pattern), F.lit(0))
        kind = lambda m: F.when(m.contains("cont"), F.when(m.contains("from"), "backward").otherwise("forward")).when(m.contains("see") | m.contains("turn"), "jump").otherwise("forward")
        page = lambda m: F.expr("cast(null as int)") if not group else F.try_element_at(F.regexp_extract_all(m, F.lit(r"(\d+)"), F.lit(1)), F.lit(-1)).cast("int")  # noqa: E731, B023
        sure = lambda m: F.least(F.lit(1.0), 0.5 + F.when(m.contains("continued"), 0.3).otherwise(0.0) + F.when(m.contains("page"), 0.2).otherwise(0.0) + F.when(m.rlike(r"\d"), 0.2).otherwise(0.0) + (0.1 if group else 0.0))  # noqa: E731, B023
        found.append(F.transform(hit, lambda m: F.struct(F.lit(k).alias("pattern"), m.alias("marker"), kind(m).alias("type"), page(m).alias("target"), sure(m).alias("confidence"))))  # noqa: B023
    return F.flatten(F.array(*found))


def suggests_continuation(a: Column, b: Column) -> Column:
    """Whether b reads on from a: a ends open, or b starts with a word that carries on."""
    starters = ["and", "but", "or", "so", "yet", "however", "therefore", "meanwhile", "furthermore"]
    return F.rtrim(F.lower(a)).rlike("(,|;|-|and|or|but)$") | F.arrays_overlap(F.slice(words(F.lower(b)), 1, 2), F.array(*map(F.lit, starters)))


def word_jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    joint = F.size(F.array_union(x, y))
    return F.when(joint > 0, F.size(F.array_intersect(x, y)) / joint).otherwise(0.0)


def caption_keywords(text: Column) -> Column:
    """Sorted keywords of a caption: credits, indicator words by substring, up to three names."""
    low = F.lower(text)
    pick = lambda test, word: F.when(test, F.lit(word))
    marks = [
        pick(low.rlike(r"\bphoto(?:graph)?s?\s*(?:by|:|credit|courtesy)"), "photo_credit"), pick(low.rlike(r"\b(?:illustration|drawing|artwork|graphic)s?\s*(?:by|:)"), "illustration_credit"), pick(low.rlike(r"\b(?:caption|figure|above|below|left|right)\b\s*:"), "caption_indicator"),
        *(pick(low.contains(w), f"photo_{w}") for w in ("photo", "photograph", "image", "picture", "shot", "captured")), *(pick(low.contains(w), f"illustration_{w}") for w in ("illustration", "drawing", "artwork", "graphic", "design")),
        *(pick(low.contains(w), f"credit_{w}") for w in ("by", "credit", "courtesy", "source", "photographer", "illustrator")),
    ]
    names = F.transform(F.slice(F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b"), F.lit(0)), 1, 3), lambda n: F.concat(F.lit("name_"), F.regexp_replace(F.lower(n), " ", "_")))
    return F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*marks)), names)))


def semantic_confidence(keywords: Column, text: Column) -> Column:
    """A caption's confidence from its keywords, their variety and its length."""
    weight = lambda k: F.when(k.isin("photo_credit", "illustration_credit"), 0.2).when(k == "caption_indicator", 0.15).when(k.startswith("name_"), 0.05).otherwise(0.1)
    bonus = F.aggregate(F.transform(keywords, weight), F.lit(0.0), lambda a, x: a + x)
    kinds = F.size(F.array_distinct(F.filter(F.transform(keywords, lambda k: F.regexp_extract(k, "^(photo|illustration|credit|name)_", 1)), lambda k: k != "")))
    n = F.size(words(text))
    long = F.when(n > 50, F.least(F.lit(0.2), (n - 50) * 0.01)).otherwise(0.0)
    return F.when(F.size(keywords) == 0, 0.3).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(1.0), 0.5 + bonus + F.when(kinds >= 2, 0.1).otherwise(0.0) - long)))


def descriptive_keywords(text: Column, stop: list[str], most: int = 4) -> Column:
    """The first words of three letters and more, without prefixes, credits and stop words."""
    t = F.regexp_replace(text, r"(?i)^(?:photo|image|picture|illustration)\s*(?:by|of|shows?)?\s*:?\s*", "")
    t = F.regexp_replace(t, r"(?i)\b(?:photo|image)\s+(?:by|courtesy|credit)\s+[^.]*", "")
    terms = [*stop, "photo", "image", "picture", "shows", "depicts", "taken", "captured"]
    return F.slice(F.filter(F.regexp_extract_all(F.lower(t), F.lit(r"\b[a-z]{3,}\b"), F.lit(0)), lambda w: ~w.isin(terms)), 1, most)


def safe_filename(name: Column, most: int = 90) -> Column:
    t = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}_\-.]", "_")
    return F.left(F.regexp_replace(F.regexp_replace(t, "_+", "_"), "^_+|_+$", ""), F.lit(most))


def person_name(text: Column) -> Column:
    """given, middle, family, prefix and suffix of a name in natural or "Family, Given" order, and its confidence."""
    t = squeezed(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\([^)]*\)|[\"“”]", ""), r"(?i)^\s*(?:by|from)\s+", ""))
    swapped = F.when(t.contains(","), F.concat(F.regexp_extract(t, r",\s*(.*)$", 1), F.lit(" "), F.regexp_extract(t, r"^([^,]*),", 1))).otherwise(t)
    suffix = F.regexp_extract(t, r"(?i)[,\s]\s*(jr|sr|ii|iii|iv|phd|md)\.?$", 1)
    natural = F.when(suffix != "", F.regexp_replace(t, r"(?i),?\s*(?:jr|sr|ii|iii|iv|phd|md)\.?$", "")).otherwise(swapped)
    prefix = F.regexp_extract(natural, r"(?i)^(dr|mr|mrs|ms|prof|sir)\.?\s", 1)
    parts = words(F.regexp_replace(natural, r"(?i)^(?:dr|mr|mrs|ms|prof|sir)\.?\s+", ""))
    n = F.size(parts)
    return F.struct(
        F.when(n > 1, F.get(parts, F.lit(0))).otherwise("").alias("given"), F.array_join(F.slice(parts, 2, F.greatest(n - 2, F.lit(0))), " ").alias("middle"), F.coalesce(F.get(parts, n - 1), F.lit("")).alias("family"),
        prefix.alias("prefix"), suffix.alias("suffix"), F.when(n == 0, 0.0).when(n == 1, 0.6).when(n <= 4, 0.95).otherwise(0.7).alias("confidence"),
    )


def is_person_name(text: Column) -> Column:
    n = F.size(words(text))
    return text.rlike(r"^[A-Z][a-zA-Z'.-]+(?: [A-Z][a-zA-Z'.-]+)+$") & n.between(2, 5) & (F.length(text) <= 60) & ~F.lower(text).isin("staff writer", "special correspondent", "staff reporter")


def issue_date(name: Column) -> Column:
    """The ISO date in a file name: year first, compact, or year last; months and days are only checked for their range."""

    def date(pattern: str, y: int, m: int, d: int) -> Column:
        year, month, day = (F.regexp_extract(name, pattern, k).cast("int") for k in (y, m, d))
        fits = name.rlike(pattern) & year.between(1900, 2100) & month.between(1, 12) & day.between(1, 31)
        return F.when(fits, F.format_string("%04d-%02d-%02d", year, month, day))

    return F.coalesce(
        date(r"(\d{4})[-_](\d{2})[-_](\d{2})", 1, 2, 3), date(r"(\d{4})(\d{2})(\d{2})", 1, 2, 3), date(r"(\d{2})[-_](\d{2})[-_](\d{4})", 3, 1, 2), date(r"(\d{1,2})[-_](\d{1,2})[-_](\d{4})", 3, 1, 2)
    )


# File name patterns of brands, in order.
BRANDS = [
    (r"economist[_\-\s]", "economist"), (r"time[_\-\s]magazine", "time"), (r"time[_\-\s]", "time"), (r"vogue[_\-\s]", "vogue"), (r"newsweek[_\-\s]", "newsweek"), (r"national[_\-\s]geographic", "national_geographic"),
    (r"natgeo[_\-\s]", "national_geographic"), (r"fortune[_\-\s]", "fortune"), (r"forbes[_\-\s]", "forbes"), (r"wired[_\-\s]", "wired"), (r"atlantic[_\-\s]", "atlantic"), (r"new[_\-\s]yorker", "new_yorker"), (r"newyorker[_\-\s]", "new_yorker"),
    (r"harper[_\-\s]?s?[_\-\s]?bazaar", "harpers_bazaar"), (r"elle[_\-\s]", "elle"), (r"cosmopolitan[_\-\s]", "cosmopolitan"), (r"cosmo[_\-\s]", "cosmopolitan"), (r"rolling[_\-\s]stone", "rolling_stone"), (r"people[_\-\s]", "people"),
    (r"entertainment[_\-\s]weekly", "entertainment_weekly"), (r"vanity[_\-\s]fair", "vanity_fair"), (r"scientific[_\-\s]american", "scientific_american"),
]


def brand(path: Column) -> Column:
    """The brand that a file's name tells, else the one its folder tells; null if neither does."""
    low = F.lower(path)
    folder = F.regexp_extract(low, r"([^/]*)/[^/]*$", 1)
    return F.coalesce(*(F.when(low.rlike(p), b) for p, b in BRANDS), *(F.when(folder.rlike(p.replace(r"[_\-\s]", "")), b) for p, b in BRANDS))


# Phrases that tell of a continuation; words of a credit line; words of a caption.
CONTINUATION_PHRASES = ["continued on page", "see page", "turn to page", "continued from", "from page"]
CREDIT_WORDS = ["by ", "photo by", "image by"]
CAPTION_WORDS = ["caption:", "figure", "table"]


def _any_of(text: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | text.contains(phrase)
    return found


def names_continuation(a: Column, b: Column) -> Column:
    """Whether either text has a phrase that tells of a continuation; false if one is empty."""
    some = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return some & (_any_of(F.lower(F.coalesce(a, F.lit(""))), CONTINUATION_PHRASES) | _any_of(F.lower(F.coalesce(b, F.lit(""))), CONTINUATION_PHRASES))


def ocr_block_type(text: Column) -> Column:
    """Type of a recognised block by its length and words: attribution, title, heading, caption or paragraph."""
    low, few = F.lower(F.trim(text)), F.size(words(text)) <= 10
    brief = F.when(_any_of(low, CREDIT_WORDS), "attribution").when(few, "title").otherwise("heading")
    return F.when(F.length(text) < 100, brief).when(_any_of(low, CAPTION_WORDS), "caption").otherwise("paragraph")


def initial(part: Column) -> Column:
    """A middle name; a single letter, with or without its dot, as a capital with a dot."""
    return F.when((F.length(part) == 1) | ((F.length(part) == 2) & part.endswith(".")), F.concat(F.upper(F.left(part, F.lit(1))), F.lit("."))).otherwise(part)


def _capital(part: Column) -> Column:
    return F.concat(F.upper(F.left(part, F.lit(1))), F.lower(F.substring(part, 2, 1 << 30)))


def capitalised(part: Column) -> Column:
    """A part of a name in its usual case: each side of a hyphen, or else of an apostrophe, and what follows two letters of mc or mac."""
    joined = lambda sign: F.array_join(F.transform(F.split(part, sign), _capital), sign)
    scottish = F.lower(part).startswith("mc") | F.lower(part).startswith("mac")
    gaelic = F.concat(_capital(F.left(part, F.lit(2))), _capital(F.substring(part, 3, 1 << 30)))
    return F.when(part.contains("-"), joined("-")).when(part.contains("'"), joined("'")).when(scottish & (F.length(part) > 2), gaelic).otherwise(_capital(part))


def full_name(prefix: Column, given: Column, middle: Column, family: Column, suffix: Column) -> Column:
    """The parts that are not empty, in natural order."""
    return F.array_join(F.filter(F.array(prefix, given, middle, family, suffix), lambda x: F.coalesce(x, F.lit("")) != ""), " ")


def last_first(prefix: Column, given: Column, middle: Column, family: Column, suffix: Column) -> Column:
    """The family name before the other parts; without one, the full name."""
    rest = full_name(prefix, given, middle, F.lit(""), suffix)
    return F.when(F.coalesce(family, F.lit("")) == "", full_name(prefix, given, middle, family, suffix)).when(rest == "", family).otherwise(F.concat(family, F.lit(", "), rest))


def name_confidence(original: Column, given: Column, family: Column, titled: Column) -> Column:
    """How sure a parsed name is: less if incomplete, very short or without parts, more if complete with a prefix or suffix."""
    complete = (given != "") & (family != "")
    base = F.when(complete, 1.0).otherwise(0.7) * F.when(F.length(F.trim(original)) < 3, 0.6).otherwise(1.0) * F.when((given == "") & (family == ""), 0.3).otherwise(1.0)
    return F.when(complete & titled, F.least(F.lit(1.0), base * 1.1)).otherwise(base)
