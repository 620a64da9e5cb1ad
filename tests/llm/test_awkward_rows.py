"""Training-data operators on awkward rows: nulls, repeats, very long texts, clashing columns, empty tables; each case's defined result."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import decontaminate, html_extract, language, licenses, privacy, quality, sharding


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["an", "be", "co", "de", "er", "fi"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, id string, good int, print long, score double, key string, size long, host string, words string"


def clashing(spark, rows):
    """Rows (doc_id, text) with columns named like those that operators make for themselves."""
    return spark.createDataFrame([(i, t, "en", "x", 7, 7, 0.5, "k", 1, "h", "w") for i, t in rows], SCHEMA)


def least_edits(item: list[str], words: list[str]) -> int:
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(31)
    words = ["a", "b", "c", "d", "e", "f"]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for k in range(25)]
    rows = []
    for k in range(120):
        text = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        if k % 2:
            part = items[rng.randrange(25)][1].split()
            for _ in range(rng.randint(0, 5)):
                at = rng.randrange(len(part) + 1)
                part[at : at + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 1)
            text = [*text[:10], *part, *text[10:]]
        rows.append((k, " ".join(text)))
    expected = {}
    for d, text in rows:
        for i, item in items:
            far = least_edits(item.split(), text.split())
            if far <= int(decontaminate.RATE * len(item.split())):
                expected[d, i] = far
    found = decontaminate.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.edits for r in found.collect()} == expected and len(expected) > 60


def test_decontamination_of_awkward_rows(spark):
    rng = random.Random(32)
    item, greek = prose(rng, 40), "ΟΔΟΣ ΚΑΙ ΛΟΓΟΣ ΑΝΘΡΩΠΟΣ ΜΕΤΡΟΝ ΠΑΝΤΩΝ"
    rows = [(0, greek), (0, greek), (None, item), (2, f"{prose(rng, 60_000)} {item}"), (3, f"{item} " * 500), (4, None), (5, "")]
    items = [(0, item), (1, greek), (1, greek), (None, None)]
    docs, bench = clashing(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    found = Counter((r.doc_id, r.item_id, r.edits) for r in decontaminate.find(docs, bench).collect())
    assert found == {(0, 1, 0): 4, (None, 0, 0): 1, (2, 0, 0): 1, (3, 0, 0): 1}
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [4, 5]


def test_quality_of_awkward_rows(spark):
    rng = random.Random(33)
    junk = lambda: " ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in prose(rng, 60).split())
    rows = [(k, junk() if k % 5 == 0 else prose(rng, 60)) for k in range(300)] + [(1, "same text again " * 20)] * 400
    rows += [(None, prose(rng, 60)), (None, None), (1001, ""), (1002, prose(rng, 60_000))]
    marks = spark.createDataFrame([(k, 1, 0) for k in range(300) if k % 5] + [(None, 1, 1), (3, None, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    docs = clashing(spark, rows)
    out = quality.classify(docs, marks).collect()
    assert len(out) == len(rows) and all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert len({r.score for r in out if r.doc_id == 1}) == 2
    kept = quality.accepted(docs, quality.learn(docs, marks))
    assert kept.columns == docs.columns


def test_class_prior_needs_no_negatives():
    rng = np.random.default_rng(4)
    good, bad = rng.normal(0.0, 1, (3000, quality.N_FEATURES)), rng.normal(0.7, 1, (3000, quality.N_FEATURES))
    for share in (0.3, 0.8):
        mixed = np.concatenate([good[1500 : 1500 + int(1500 * share)], bad[: 1500 - int(1500 * share)]])
        assert abs(quality.class_prior(good[:1500], rng.permutation(mixed)) - share) < 0.1


def test_surrogates_of_awkward_rows(spark):
    rng = random.Random(34)
    long_domain = "x@" + "a." * 2000 + "com"
    rows = [(0, long_domain), (0, long_domain), (1, None), (2, ""), (3, f"{prose(rng, 60_000)} joe@a.org."), (None, "joe@a.org"), (5, "x@a.com. Next x@b.com.1 y@c.d.example.org, z@1.2.3")]
    docs = clashing(spark, rows)
    out = privacy.pseudonymise(docs, "key")
    assert out.columns == docs.columns
    found = out.collect()
    assert len(found) == len(rows) and [r.text for r in found if r.doc_id in (1, 2)] == [None, ""]
    twice = [r.text for r in found if r.doc_id == 0]
    assert twice[0] == twice[1] and "@" in twice[0] and twice[0] != long_domain
    one = next(r.text for r in found if r.doc_id is None)
    assert next(r.text for r in found if r.doc_id == 3) == rows[4][1].replace("joe@a.org", one)
    assert re.fullmatch(r"\w@\w+\.example\.\w+\. Next \w@\w+\.example\.\w+\.1 \w@\w+\.example\.\w+, z@1\.2\.3", found[6].text)
    assert privacy.pseudonymise(docs.limit(0), "key").count() == 0
    with pytest.raises(ValueError, match="key"):
        privacy.pseudonymise(docs, "")
    assert {r.text for r in privacy.pseudonymise(docs, "other").collect()} & {r.text for r in found} == {None, ""}


def test_many_short_secrets_stay_apart(spark):
    rng = random.Random(35)
    secrets = {"".join(rng.choice("abcdef") for _ in range(6)) for _ in range(2000)}
    docs = spark.createDataFrame([(k, f'token = "{s}"') for k, s in enumerate(sorted(secrets))], "doc_id long, text string")
    drawn = {re.fullmatch(r'token = "(.+)"', r.text).group(1) for r in privacy.pseudonymise(docs, "key").collect()}
    assert len(drawn) == len(secrets) and not drawn & secrets


def luhn(digits: str) -> bool:
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_only_cards_with_a_right_check_digit_are_replaced(spark):
    rng = random.Random(36)
    numbers = ["".join(rng.choice("0123456789") for _ in range(rng.randint(13, 18))) for _ in range(400)]
    docs = spark.createDataFrame([(k, f"paid by {x} then") for k, x in enumerate(numbers)], "doc_id long, text string")
    counts = {r.doc_id: r.n for r in docs.select("doc_id", privacy.count_entities("text").alias("n")).collect()}
    seen = set()
    for r in privacy.pseudonymise(docs, "key").collect():
        old, new = numbers[r.doc_id], r.text.split(" ")[2]
        assert counts[r.doc_id] == luhn(old) and (new != old or not luhn(old))
        assert luhn(new) == luhn(old) and len(new) == len(old) and new[0] == old[0]
        seen.add(new)
    assert len(seen) == len(set(numbers)) and sum(map(luhn, numbers)) > 20


def test_forms_of_cards_accounts_and_quoted_digits(spark):
    texts = ["4111 1111 1111 1111 4111111111111111", "4111 1111 1111 1112", 'password = "4111111111111112" or "4111111111111112"', 'token: "123456" secret=\'user@host\'', "DE89370400440532013000 DE89 3704 0044 0532 0130 00", "DE88370400440532013000"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [r.text for r in privacy.pseudonymise(docs, "key").orderBy("doc_id").collect()]
    spaced, plain = re.fullmatch(r"(4\d{3}(?: \d{4}){3}) (4\d{15})", out[0]).groups()
    assert spaced.replace(" ", "") == plain != "4111111111111111" and luhn(plain)
    assert out[1] == texts[1]
    assert re.fullmatch(r'password = "\d{16}" or "4111111111111112"', out[2]) and out[2].count("4111111111111112") == 1
    assert re.fullmatch(r"token: \"\d{6}\" secret='[a-z]{4}@[a-z]{4}'", out[3]) and "123456" not in out[3] and "user@host" not in out[3]
    plain, spaced = re.fullmatch(r"(DE\d{20}) (DE\d\d(?: \d{4}){4} \d\d)", out[4]).groups()
    assert spaced.replace(" ", "") == plain != "DE89370400440532013000" and int(plain[4:] + "1314" + plain[2:4]) % 97 == 1
    assert out[5] != texts[5] and re.fullmatch(r"[A-Z]{2}\d{20}", out[5])


def test_shards_of_awkward_rows(spark):
    rng = random.Random(36)
    rows = [(None, "same"), (9, "same")] * 1500 + [(k, prose(rng, 30)) for k in range(300)] + [(1, prose(rng, 60_000)), (2, None), (2, "")]
    docs = clashing(spark, rows)
    out = sharding.assign(docs).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for r in out:
        sizes[r.shard] += r.size
    total, most = sum(sizes.values()), max(r.size for r in out)
    assert all(abs(s - total / 8) <= most for s in sizes.values())
    for shard in sizes:
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))


def test_languages_of_awkward_rows(spark):
    rng = random.Random(37)
    rows = [(k, prose(rng, 30)) for k in range(60)] + [(1, "same"), (1, "same"), (None, "bede code"), (100, None), (101, ""), (102, prose(rng, 60_000)), (103, "\U00030000\U00030001"), (104, "12 !?")]
    out = language.classify(clashing(spark, rows)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert [by[k].lang_pred for k in (100, 101, 104)] == ["und"] * 3 and by[102].lang_pred == "en" and by[103].lang_pred == "en"
    assert not by[None].held_out and all(0 <= r.score <= 1 for r in out)
    assert language.classify(clashing(spark, rows).limit(0)).count() == 0


def test_licenses_of_awkward_rows(spark):
    rng = random.Random(38)
    rows = [(0, None), (0, ""), (None, "mit license"), (1, "mit license"), (1, "mit license"), (2, f"{prose(rng, 60_000)} Apache License {prose(rng, 10)}")]
    out = licenses.scan(clashing(spark, rows)).collect()
    assert len(out) == 6 and [r.labels for r in out] == ["", "", "mit", "mit", "mit", "apache"]
    assert (out[5].n_words, out[5].first_word) == (60_012, 60_000)
    assert licenses.scan(clashing(spark, rows).limit(0)).count() == 0


def test_pages_of_awkward_rows(spark):
    rng = random.Random(39)
    pages = [(0, "http://h.example/", f"<article><p>{prose(rng, 60_000)}</p></article>")] + [(1, "http://h.example/1", "<p>twice</p>")] * 2
    pages += [(2, None, "<p>x</p>"), (None, "http://h.example/2", None), (4, "http://h.example/3", "")]
    docs = spark.createDataFrame([(*p, "t", 1, "x", "y") for p in pages], "page_id long, url string, html string, text string, n_chars int, host string, templates string")
    out = html_extract.extract(docs).collect()
    assert len(out) == 6 and sorted(r.n_chars for r in out)[:5] == [0, 0, 1, 5, 5]
    assert all(r.n_chars == len(r.text) for r in out)
    assert html_extract.extract(docs.limit(0)).count() == 0
