"""Each training-data operator against brute force, an exact round trip or planted cases, with awkward rows among them."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import bpe, decontaminate, html_extract, language, licenses, near_dedup, perplexity, privacy, quality, sharding
from quire.llm._core import word_hashes
from quire.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["an", "be", "co", "de", "er", "fi"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def awkward(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a very long text, and a column whose name clashes."""
    rng = random.Random(5)
    texts = [None, "", " \n\t ", "one", "one", "x" * 200_000, prose(rng, 30_000), "Ünï cödé 日本 🎉", prose(rng, 80), "\x00\x1f a b"]
    rows = [(k, t, ["en", "de", None][k % 3], "a", len(t or "")) for k, t in enumerate(texts)] + [(3, "one", "en", "a", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, token_ids string, n_chars long")


def test_word_hashes_match_words():
    rng = random.Random(1)
    text = "".join(rng.choice("abAB é\n\t\x0b") for _ in range(5000)) + "y" * 1_200_000 + " z"
    words = [w.translate(LOWER) for w in WORD.findall(text)]
    hashes, _ = word_hashes(np.frombuffer(text.encode(), np.uint8))
    assert len(hashes) == len(words) and len(set(zip(words, hashes.tolist(), strict=True))) == len(set(words))


# --- 1: byte-pair encoding


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(vocabulary())


def test_bpe_equals_library(codec, monkeypatch):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(vocabulary())
    monkeypatch.setattr(bpe, "BUFFER", 8)
    monkeypatch.setattr(bpe, "WINDOW", 50)
    rng = random.Random(2)
    parts = ["a", "the", "ing", " ", "  ", "\n", "é", "ß", "12", "'s", "'ll", "$$", "日", "🎉", "<|endoftext|>", "　", "\x1c", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 150))) for _ in range(300)]
    texts += ["".join(rng.choice("etaoin") for _ in range(4000)) for _ in range(20)] + ["a" * 3000, "", " " * 500 + "x"]
    for text in texts:
        codec.known.clear()
        pieces = [p for p in codec.encode(text) if p]
        ids = reference.encode(text, add_special_tokens=False).ids
        assert [int(i) for p in pieces for i in p.split(",")] == ids
        assert "".join(codec.decode(pieces)) == reference.decode(ids, skip_special_tokens=False)
    assert 0 < codec.lookahead < 200


def test_bpe_queries(spark):
    docs = awkward(spark)
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(vocabulary())
    for row, text in zip(bpe.digests(docs, vocabulary()).collect(), [r.text for r in docs.collect()], strict=True):
        ids = reference.encode(text or "", add_special_tokens=False).ids
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, vocabulary()), vocabulary()).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert bpe.encode(docs.limit(0), vocabulary()).count() == 0


# --- 2: personal data


def test_surrogates(spark):
    texts = [
        "mail jo.81@mail7.example.com or JO.81@MAIL7.EXAMPLE.COM!! call +1 (017) 555-7713%%% from 226.203.165.104.",
        'card 4845168114407329$$$ token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" 123-45-6789',
        "Ask Mr. Smith and Frau Anna Müller; write ключ@почта.рф",
        "clean text, version 2.0, in 1999 and 12.5 percent", None, "", "jo.81@mail7.example.com",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [r.text for r in privacy.pseudonymise(docs, "key").orderBy("doc_id").collect()]
    assert out[3:6] == texts[3:6]
    for secret in ("jo.81@", "555-7713", "226.203.165.104", "4845168114407329", "2abc3ff2", "123-45-6789", "Smith", "Müller", "ключ"):
        assert secret.lower() not in " ".join(x or "" for x in out).lower()
    mails = re.findall(r"\S+@[A-Za-z.]+", out[0])
    assert mails[0] == mails[1].lower() and mails[1] == mails[1].upper() and out[6] == mails[0]
    assert re.search(r"call \+1 \(\d{3}\) \d{3}-\d{4}%%% from (\d{1,3}\.){3}\d{1,3}\.$", out[0])
    assert re.fullmatch(r'card \d{16}\$\$\$ token = "[0-9a-f]{40}" \d{3}-\d{2}-\d{4}', out[1])
    assert re.match(r"Ask Mr\. [A-Z][a-z]+ and Frau [A-Z][a-z]+ [A-Z][a-z]+; write [а-я]+@", out[2])
    counts = docs.select(privacy.count_entities("text").alias("n")).collect()
    assert [r.n for r in counts] == [4, 3, 3, 0, 0, 0, 1]


def test_surrogates_keep_entities_apart(spark):
    rows = [(k, f"{4000000000000000 + k} u{k}@a.org 10.0.{k // 250}.{k % 250}") for k in range(2000)]
    out = privacy.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()
    for place in range(3):
        assert len({r.text.split(" ")[place] for r in out}) == 2000


def test_surrogates_of_short_and_foreign_secrets(spark):
    secrets = ["******", "******!", "密码密码密码", "كلمةالسر", "------", "password", "######"]
    texts = [f'token = "{s}"' for s in secrets] + ['token = "******"', "Mr. Smith met Dr Smith and Frau Smith", "Mr. Иванов"]
    out = [r.text for r in privacy.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").orderBy("doc_id").collect()]
    drawn = [re.fullmatch(r'token = "(.+)"', x).group(1) for x in out[:8]]
    assert len(set(drawn[:7])) == 7 and not set(drawn) & set(secrets) and drawn[7] == drawn[0]
    assert re.fullmatch(r"[\u4e00-\u9fff]{6}", drawn[2]) and re.fullmatch(r"[\u0600-\u06ff]{8}", drawn[3])
    family = re.fullmatch(r"Mr\. (\w+) met Dr (\w+) and Frau (\w+)", out[8]).groups()
    assert len(set(family)) == 1 and family[0] != "Smith"
    assert re.fullmatch(r"Mr\. [А-Я][а-я]{5}", out[9]) and out[9] != texts[9]


def test_secrets_with_one_surrogate_part(spark, monkeypatch):
    monkeypatch.setattr(privacy, "_digest", lambda id_, key: f"repeat(CASE WHEN {id_} LIKE '%|%' THEN sha2({id_}, 512) ELSE '0' END, 512)")
    rows = [(k, f'token = "{s}"') for k, s in enumerate(["abcabc", "bcabca", "cabcab"])]
    out = [r.text for r in privacy.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()]
    assert len(set(out)) == 3 and not set(out) & {t for _, t in rows}


def test_collision_check_works_surrogates_out_once(spark):
    docs = spark.createDataFrame([(1, 'Mr. Smith wrote to a@b.de, token = "abcdef"')], "doc_id long, text string")
    collided = privacy._colliding(privacy._drawn_entities(docs), "key", 0)
    # a plan with shuffles is planned again after each of them, so it must not hold the surrogates' huge expression
    assert "sha2" not in collided._jdf.queryExecution().optimizedPlan().toString()
    assert collided.isEmpty()


# --- 3: html


@pytest.mark.parametrize(("page", "text"), [
    ('<body><nav><a href="/">x</a></nav><article><h1>T &amp; x</h1><p>One <b>bo</b>ld<p>Two&nbsp;three<br>four</article><footer>f', "T & x One bold Two three four"),
    ('<div class="content">a<div class="comments"><p>c</p></div><form>f</form></div><div class="cookie-notice">n</div>', "a"),
    ('<div class="sidebar-right"><main><header><h1>H</h1></header><p>y</p><aside>z</aside></main></div>', "H y"),
    ("<script>if (a<b) '</p>'</script>plain < text <!-- no --> &lt;", "plain < text <"),
    ("", ""), ("<p ", ""),
    ("<div>" * 30 + "<nav>MENU</nav><article>Body", "Body"), ("<div>" * 5000 + "<article>Body", "Body"),
    (f'<div class="{" ".join(f"c{chr(97 + k % 26) * 5}{chr(97 + k // 26)}" for k in range(60))} sidebar">SIDE</div><article>Body</article>', "Body"),
    ("<article><math>x</math> <object>y</object> <canvas>z</canvas></article>", "x y z"),
])
def test_main_text(page, text):
    assert html_extract.main_text(page, []) == text


def test_wrappers_find_templates(spark):
    pages = [(k, f"http://h.example/{k}", f"<body><div><p>Same words everywhere</p></div><section><p>Text {k} {'is long ' * k}</p></section></body>") for k in range(6)]
    pages += [(6, None, None), (7, "", ""), (8, "http://other.example", "<p>Same words everywhere</p>")]
    out = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out[3] == "Text 3 is long is long is long" and out[6] == out[7] == "" and out[8] == "Same words everywhere"


def page_of(*tags: str) -> list:
    """A stream of blocks (path by name, text after a colon or as the name)."""
    return [(zlib.crc32(x.partition(":")[0].encode()), x.partition(":")[0], "other", 0, x.partition(":")[2] or x) for x in tags]


@pytest.mark.parametrize(("pages", "expected"), [
    ([["a", "b:1"], ["a", "b:2"]], "a:text b:#text"),
    ([["a", "b", "c"], ["a", "c"]], "a:text b:text? c:text"),
    ([["a", "b:1", "b:2", "b:3", "c"], ["a", "b:4", "c"]], "a:text b:#text+ c:text"),
    ([["a", "h:1", "p:1", "h:2", "p:2", "z"], ["a", "h:3", "p:3", "z"]], "a:text (h:#text p:#text)+ z:text"),
    ([["a", "z"], ["a", "h:1", "p:1", "h:2", "p:2", "z"]], "a:text (h:#text p:#text)* z:text"),
    ([["a", "x", "b"], ["a", "y", "b"]], "a:text x:text? y:text? b:text"),
    ([["p:1", "u", "p:f"], ["p:2", "p:3", "u", "p:f"]], "p:#text+ u:text p:text"),
])
def test_alignment(pages, expected):
    found = html_extract.page_items(page_of(*pages[0]))
    for page in pages[1:]:
        found = html_extract.align(found, html_extract.page_items(page_of(*page)))
    assert html_extract.expression(found) == expected


def test_wrapper_accepts_its_pages():
    """Every page of a small host reads as a word of the inferred expression, whatever the order and folds of alignment."""
    rng = random.Random(25)

    def pattern(items: list) -> str:
        return "".join(f"(?:{pattern(x[3]) if isinstance(x[3][0], list) else f'{x[0]},'})" + ("", "?", "+", "*")[x[1]] for x in items)

    for _ in range(60):
        pages = [page_of(*("nav", *(rng.choice(["h", "p", "u"]) + f":{rng.random()}" for _ in range(rng.randint(0, 7))), "foot")) for _ in range(rng.randint(2, 6))]
        half = len(pages) // 2 or 1
        parts = []
        for some in (pages[:half], pages[half:]):
            found = None
            for page in some:
                items = html_extract.page_items(page)
                found = items if found is None else html_extract.align(found, items)
            parts += [found] if found else []
        whole = parts[0] if len(parts) == 1 else html_extract.align(*parts)
        for page in pages:
            assert re.fullmatch(pattern(whole), "".join(f"{x[0]}," for x in page)), html_extract.expression(whole)


def test_wrapper_decides_by_place(spark):
    """Paths are equal; what stands before and after the list is told apart by the alignment alone."""
    rng = random.Random(24)
    pages = [(k, "http://h.example/", f"<div><p>{prose(rng, 5)} {k}</p><ul><li>{prose(rng, 2)} {k}</ul><p>All prices include tax</p></div>") for k in range(9)]
    out = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(out[k] == " ".join(" ".join(re.sub("<[^>]*>", " ", page).split()).split()[:-4]) for k, _, page in pages)


# --- 4: perplexity rules


def base(text: str) -> tuple[int, ...]:
    words = WORD.findall(text)
    found = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + j for i in range(len(words) - 2) if found[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def test_base_rules():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b", "A", "é", " ", "\n", "\x0b", "&", " ", "a b c"]) for _ in range(rng.randint(0, 60)))
        assert perplexity.base(np.frombuffer(text.encode(), np.uint8)) == base(text)


def plain_model(texts: list[str]) -> tuple[dict[str, float], list[list[str]]]:
    """Modified Kneser-Ney by dictionaries: the probability of every n-gram of the texts, and each text's n-grams."""
    n = perplexity.ORDER
    streams = ["\0" * (n - 1) + re.sub(r"[\x00 \t-\r]+", " ", t) for t in texts]
    found = [[s[k : k + n] for k in range(len(s) - n + 1)] for s in streams]
    levels = {n: Counter(g for x in found for g in x)}
    for k in range(n, 1, -1):
        levels[k - 1] = Counter(g[1:] for g in levels[k])
    below = dict.fromkeys(levels[1], 1 / (len(levels[1]) + 1))
    lower: dict[str, float] = {}
    for k in range(1, n + 1):
        n1, n2, n3, n4 = (sum(c == x for c in levels[k].values()) for x in (1, 2, 3, 4))
        y = n1 / max(n1 + 2 * n2, 1)
        cut = [min(max(c - (c + 1) * y * b / max(a, 1), 0.1), c - 0.1) for c, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        total, freed = Counter(), Counter()
        for g, c in levels[k].items():
            total[g[:-1]] += c
            freed[g[:-1]] += cut[min(c, 3) - 1]
        lower = {g: (c - cut[min(c, 3) - 1]) / total[g[:-1]] + freed[g[:-1]] / total[g[:-1]] * (below[g] if k == 1 else lower[g[1:]]) for g, c in levels[k].items()}
    return lower, found


def test_perplexities_equal_a_plain_model(spark, monkeypatch):
    monkeypatch.setattr(perplexity, "PIECE", 40)
    monkeypatch.setattr(perplexity, "LOCAL", 12)
    monkeypatch.setattr(perplexity, "BUCKET", 400)
    rng = random.Random(23)
    parts = {"xx": ["the ", "cat", "\n\n", "é", "日本", "\x00", "🎉"], None: ["und ", "der", "\t", "ß"]}
    rows = [(k, "".join(rng.choice(parts[x]) for _ in range(rng.randint(0, 40))), x) for k, x in enumerate(rng.choice(list(parts)) for _ in range(60))]
    rows += [(100, "".join(map(chr, range(0x4E00, 0x4E00 + 9000))), "zz"), (101, None, "xx"), (101, None, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    out = {r.doc_id: r for r in perplexity.measured(docs).collect()}
    for lang in ("xx", None, "zz"):
        some = [(i, t or "") for i, t, x in rows if x == lang]
        model, found = plain_model([t for _, t in some])
        for (i, _), grams in zip(some, found, strict=True):
            assert out[i].n_chars == len(grams)
            assert out[i].log_perplexity == (pytest.approx(-sum(map(np.log, map(model.get, grams))) / len(grams), rel=1e-6) if grams else None)


def test_perplexity_rules(spark):
    rng = random.Random(8)
    rows = [(k, prose(rng, 120), "en") for k in range(60)] + [(100, " ".join("".join(rng.choice("qxzjvwk9#") for _ in range(6)) for _ in range(120)), "en"), (101, None, None), (102, "few words", "en")]
    out = {r.doc_id: r for r in perplexity.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[k].kept for k in range(60)) and not out[100].kept and not out[100].base_failed
    assert out[101].base_failed and not out[101].kept and out[101].n_words == 0 and out[102].base_failed
    assert perplexity.apply_rules(awkward(spark)).count() == 11
    assert perplexity.apply_rules(awkward(spark).limit(0)).count() == 0


# --- 5: shards


def test_shards(spark):
    rng = random.Random(6)
    rows = [(k, "copy of a text" if k % 3 == 0 else prose(rng, rng.randint(0, 60))) for k in range(900)] + [(1000, None), (1000, None), (None, "x")]
    out = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for r in out:
        sizes[r.shard] += r.size
    total, most = sum(sizes.values()), max(r.size for r in out)
    assert set(sizes) == set(range(8)) and all(abs(s - total / 8) <= most for s in sizes.values())
    for shard in range(8):
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))
    texts = dict(rows)
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in out)
    assert sharding.assign(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shards_equal_one_sorted_list(spark):
    """All rows sorted in one list and cut by their middles, against the sampled ranges."""
    rng = random.Random(26)
    rows = [(k, "copy of a text" if k % 3 == 0 else prose(rng, rng.randint(0, 60))) for k in range(700)] + [(1000, None), (None, "x"), (1001, prose(rng, 5000))]
    number = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
    placed = sorted((number(t or ""), number("" if i is None else str(i)), i, len((t or "").encode()) + 1) for i, t in rows)
    total, before, expected, slots = sum(x[3] for x in placed), 0, {}, Counter()
    for _, _, i, size in placed:
        shard = min(7, (2 * before + size) * 8 // (2 * total))
        expected[i] = (shard, slots[shard])
        slots[shard] += 1
        before += size
    out = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in out} == expected


def test_overfull_ranges_are_subdivided(spark):
    rows = spark.range(4000).selectExpr("CASE WHEN id % 2 = 0 THEN 7L ELSE xxhash64(id) END AS key", "CASE WHEN id % 4 = 0 THEN 7L ELSE xxhash64(id) END AS sub", "xxhash64(id) AS salt", "10L AS size")
    splits = sharding.splitters(rows, 40_000, 64)
    sizes = rows.groupBy(sharding._range_of(splits)).sum("size").collect()
    assert max(r[1] for r in sizes) <= 2 * 40_000 // 64


# --- 6: language


def test_language(spark):
    rng = random.Random(7)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(30))
    rows = [(k, make(["tion", "ing", "the"]) if k % 2 else make(["ung", "sch", "über"]), "en" if k % 2 else "de") for k in range(200)]
    rows += [(1000, None, "en"), (1001, "123 !!", "de"), (1002, "", None)]
    out = {r.doc_id: r for r in language.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[k].lang_pred == lang for k, _, lang in rows[:200])
    assert all(out[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, _, _ in rows)
    assert [out[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in out.values())
    assert {r.lang_pred for r in language.classify(spark.createDataFrame([(2, "abc", None)], "doc_id long, text string, lang string")).collect()} == {"und"}


def test_filters_contain_what_they_own():
    known, other = (np.arange(k, 1 << 40, 1 << 30, dtype=np.uint64) for k in (1, 2))
    words = [(np.concatenate(list(language.places(x))), np.full(4 * len(x), 1 << bit, np.uint64)) for bit, x in enumerate((known, other))]
    filters = language.Filters.of(["a", "b"], [tuple(np.concatenate(x) for x in zip(*words, strict=True))])
    assert (filters.masks(known)[0] & np.uint64(1)).all() and (filters.masks(other)[0] & np.uint64(2)).all()
    assert (filters.masks(known)[0] & np.uint64(2)).sum() < 10 and (filters.false_rate < 1e-6).all()


def plain_grams(text: str) -> list[str]:
    letters = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
    letters = f" {letters} " if letters else ""
    return [letters[k : k + n] for n in language.ORDERS for k in range(len(letters) - n + 1)]


def test_languages_equal_exact_sets(spark, monkeypatch):
    """Against sets of n-grams without filters, on whole texts."""
    monkeypatch.setattr(language, "PIECE", 7)
    rng = random.Random(27)
    parts = {"xx": ["tion", "ing", "the"], "yy": ["ung", "sch", "über", "the"], "zz": ["ción", "que", "ing"]}
    rows = [(k, " ".join("".join(rng.choice(parts[x]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 12))), x) for k, x in enumerate(rng.choice(list(parts)) for _ in range(150))]
    counts = {x: Counter() for x in parts}
    for k, text, x in rows:
        if zlib.crc32(str(k).encode()) % 4 != 2:
            counts[x].update(plain_grams(text))
    share = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in counts.items()}
    owned = {x: {g for g, s in share[x].items() if s >= language.SHARE * max(share[y].get(g, 0) for y in share)} for x in share}
    for r in language.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect():
        found = plain_grams(rows[r.doc_id][1])
        part = {x: sum(g in owned[x] for g in found) / len(found) for x in sorted(owned)}
        assert r.lang_pred == max(part, key=part.get) and r.score == pytest.approx(part[r.lang_pred] / sum(part.values()), abs=1e-3)


# --- 7: near duplicates


def shingles(text: str | None) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute_classes(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    sets, parent = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in rows}


def near_rows(n: int) -> list[tuple[int, str | None]]:
    rng = random.Random(9)
    rows: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, "one two"), (3, "ONE two"), (4, "a " * 50_000)]
    seed = prose(rng, 120).split()
    for k in range(5, n):
        words = list(seed) if k % 3 else prose(rng, rng.randint(3, 150)).split()
        for _ in range(rng.randint(0, 6) if k % 3 else 0):
            words[rng.randrange(len(words))] = prose(rng, 1)
        rows.append((k, " ".join(words)))
    return rows


def test_near_duplicates(spark):
    rows = near_rows(260)
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    classes = brute_classes(rows)
    assert {r.doc_id: r.component_id for r in out} == classes
    assert all(r.n_shingles == len(shingles(dict(rows)[r.doc_id])) and r.kept == (r.doc_id == r.component_id) for r in out)


def test_near_duplicates_in_small_rounds(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "TRIES", 1)
    rows = near_rows(150)
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == brute_classes(rows)


def test_near_duplicates_in_blocks_of_few_shingles(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "HELD", 300)
    monkeypatch.setattr(near_dedup, "MARKS", 700)
    rows = near_rows(150)
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == brute_classes(rows)


def test_pairs_grow_with_a_group_not_with_its_square(spark, monkeypatch):
    rng = random.Random(12)
    seed, rows = [f"w{rng.randrange(10**6)}" for _ in range(400)], []
    for k in range(160):  # most pairs are alike and not linked; every tenth text is a near copy of the one before
        words = list(rows[-1][1].split() if k % 10 == 9 else seed)
        for place in rng.sample(range(400), 1 if k % 10 == 9 else 8):
            words[place] = f"x{rng.randrange(10**9)}"
        rows.append((k, " ".join(words)))
    real, pairs = near_dedup.written, []

    def counted(df):
        out = real(df)
        pairs.append(out.count() if {"a", "b"} <= set(out.columns) else 0)
        return out

    monkeypatch.setattr(near_dedup, "written", counted)
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == brute_classes(rows)
    assert sum(pairs) < 160 * 160 / 4


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert near_dedup.near_duplicates(awkward(spark)).count() == 11


def test_estimates_follow_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.75, 0.9):
        both = rng.integers(0, 1 << 63, int(2000 * share), dtype=np.uint64)
        sets = [np.unique(np.concatenate([both, rng.integers(0, 1 << 63, int(1000 * (1 - share)), dtype=np.uint64)])) for _ in range(2)]
        true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        a, b = (near_dedup.set_sketches([s], near_dedup.REGISTERS, near_dedup.FINE, near_dedup.ESTIMATING) for s in sets)
        found = near_dedup.likelihood(a, b, np.array([float(len(sets[0]))]), np.array([float(len(sets[1]))]))[0]
        assert abs(found - true) < 0.08


# --- 8: benchmark items


def test_myers_distance():
    rng = random.Random(10)
    for _ in range(800):
        p, t = ([rng.randint(0, 3) for _ in range(rng.randint(a, b))] for a, b in ((1, 12), (0, 15)))
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            new = [i]
            for j, y in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        masks: dict[int, int] = {}
        for k, x in enumerate(p):
            masks[x] = masks.get(x, 0) | 1 << k
        assert decontaminate.distance(masks, len(p), t)[0] == min(row)


def test_decontamination(spark):
    rng = random.Random(11)
    items = [(k, prose(rng, 40)) for k in range(6)] + [(6, None), (7, "")]
    item = items[2][1].split()
    edited = item[:10] + ["new"] + item[11:20] + item[21:30] + ["more", *item[30:]]
    spoilt = [w if k % 4 else "zz" for k, w in enumerate(item)]
    around = prose(rng, 50)
    rows = [(0, f"{around} {items[0][1]} {around}"), (1, items[1][1].upper().replace(" ", "!! ")), (2, f"{around} {' '.join(edited)}"), (3, " ".join(spoilt)), (4, around), (5, None), (6, ""), (None, items[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find(docs, bench).collect()}
    assert found == {(0, 0): 0, (1, 1): 0, (2, 2): 3, (None, 3): 0}
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [3, 4, 5, 6]
    assert decontaminate.find(docs, bench.limit(0)).count() == 0 and decontaminate.find(docs.limit(0), bench).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    rng = random.Random(12)
    items = [(k, prose(rng, 20)) for k in range(12)]
    docs = spark.createDataFrame([(k, t) for k, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find(docs, bench).collect()} >= {(k, k) for k in range(12)}


# --- 9: licences


def test_license_scan(spark):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    rng = random.Random(13)
    texts = [None, "", "mit license MIT-License,cc by cc by", "Under the GNU General Public License, version 3.", "mit einer Lizenz", "All rights reserved."]
    texts += [" ".join(rng.choice(["mit", "license", "cc", "by", "gnu general public", "apache", "é"]) for _ in range(rng.randint(0, 30))) for _ in range(120)]
    out = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        words = pattern.findall((text or "").translate(LOWER))
        at = [(i, label) for phrase, label in phrases.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        r = out[k]
        assert (r.n_words, r.n_base) == (len(words), len(at)) and r.base_labels == ",".join(sorted({x for _, x in at}))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert out[5].labels == "reserved" and out[5].base_labels == ""


def test_license_notice_without_base_phrase(spark):
    text = "foo bar. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.labels, r.base_labels, r.n_base) == ("mit", "", 0) and r.score > 0.6


# --- 10: quality


def test_quality(spark):
    rng = random.Random(14)
    junk = lambda: " ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in prose(rng, 60).split())
    rows = [(k, junk() if k % 5 == 0 else prose(rng, 60)) for k in range(600)] + [(1000, None), (1001, "")]
    labels = [(k, 0 if k % 5 == 0 else 1) for k in range(0, 600, 2)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.classify(docs, marks).collect()}
    assert np.mean([out[k].predicted == (k % 5 != 0) for k in range(600) if out[k].held_out]) > 0.97
    assert all(out[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= out[k].score <= 1 for k in out)
    assert out[1000].score == out[1001].score < 0.3 and len(out) == 602  # scored like any text
    assert quality.classify(docs, marks.limit(0)).count() == 602 and quality.classify(docs.limit(0), marks).count() == 0


def test_risk_never_goes_negative_for_long():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (400, quality.N_FEATURES))
    x[:200] += 1
    model = quality.fit(x[:100], x, 0.5, epochs=20)
    assert (model.score(x[:200]) > model.score(x[200:]).mean()).mean() > 0.9


# --- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(15)
    items = [(k, prose(rng, 40)) for k in range(3)]
    good = [prose(rng, 150) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(good)]
    rows += [(100 + k, " ".join(w + "###" for w in prose(rng, 100).split())) for k in range(20)]
    rows += [(200, good[3]), (201, good[4] + " more"), (202, f"{prose(rng, 60)} {items[1][1]}"), (203, f"{prose(rng, 100)} jo.1@mail.example.com"), (204, None), (205, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1 if k < 100 else 0, 0) for k in [*range(60), *range(100, 120)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {*range(60), 203}
    text = "".join(bpe.codec(vocabulary()).decode([",".join(map(str, out[203].token_ids))]))
    assert "jo.1@mail" not in text and text.startswith(dict(rows)[203][:300])
    assert "".join(bpe.codec(vocabulary()).decode([",".join(map(str, out[5].token_ids))])) == good[5] and out[5].n_tokens == len(out[5].token_ids)


def test_near_duplicate_stage_without_or_with_repeated_ids(spark):
    import corpus_pipeline

    rng = random.Random(21)
    a, b, c, d = (prose(rng, 120) for _ in range(4))
    rows = [(None, a), (None, b), (1, b), (2, c), (2, c), (3, d), (3, d + " more"), (3, a + " more"), (None, None), (4, "")]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(repr(r) for r in out_rows(out, a, b, c, d))


def out_rows(out, a, b, c, d):
    """One of each class: b's under its id, d's of one text or the other."""
    last = next(r.text for r in out if r.text in (d, d + " more"))
    return [(3, a + " more"), (1, b), (2, c), (3, last), (None, None), (4, "")]
