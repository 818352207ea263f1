"""Row-by-row operators against plain versions of their contracts."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import best_fit_packing as packing
from tidelog.llm import decontamination, license_scan, lm_scoring, personal_data, quality_rules, web_archive

SCHEMA = "doc_id long, text string, row string, t string, hash string"
ODD = [(900, None), (901, ""), (902, " \n\t "), (None, "no id here at all"), (903, "x" * 30_000), (904, "same"), (904, "same"), (905, "é à ü ß " * 40), (906, "\n" * 50)]


def frame(spark, rows):
    """Rows as documents with other columns, whose names operators use inside."""
    return spark.createDataFrame([(i, t, "r", "t", "h") for i, t in rows], SCHEMA)


def some_texts(n=60, seed=3):
    random.seed(seed)
    vocabulary = ["The", "tide", "LOG", "of", "café", "a", "b.", "c@d.e", "1.2.3.4", "x|y", "#1", "+49 123 4567", "4111 1111 1111 1111"]
    return [(i, "".join(random.choice(vocabulary) + random.choice([" ", "  ", "\n", "\t"]) for _ in range(random.randint(0, 90)))) for i in range(n)]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# hashes


def thue_morse(n, flip=0):
    return "".join("ab"[i.bit_count() + flip & 1] for i in range(n))


def test_hashes_of_words_lines_and_windows_of_thue_morse_strings():
    from tidelog.llm import textkit as tk

    for n in (1, 7, 8, 9, 64, 1024, 1 << 14):
        data = np.frombuffer(f"{thue_morse(n)} {thue_morse(n, 1)}".encode(), np.uint8)
        one, two = tk.words(data, np.array([0, len(data)]))[0].tolist()
        assert one != two
        again = np.frombuffer(f"xyz {thue_morse(n, 1)}".encode(), np.uint8)
        assert tk.words(again, np.array([0, len(again)]))[0][1] == two
    rng, seen = random.Random(1), {}
    own = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 18))) for _ in range(30_000)]
    data = np.frombuffer(" ".join(own).encode(), np.uint8)
    for h, w in zip(tk.words(data, np.array([0, len(data)]))[0].tolist(), own, strict=True):
        assert seen.setdefault(h, w) == w
    assert len(seen) == len(set(own))


# quality rules


def plain_counts(text):
    text = text or ""
    own, seen, dup = words(text), set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(own[i : i + 8]) for i in range(len(own) - 7))
    covered = {j for i in range(len(own) - 7) if windows[tuple(own[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_rules(spark):
    rows = some_texts() + ODD + [(907, "one two three four five six seven eight " * 9), (908, thue_morse(1024) + "\n" + thue_morse(1024, 1))]
    labels = spark.createDataFrame([(i, 1, 0, "x") for i in range(0, 60, 2)] + [(None, 1, 0, "y"), (904, 1, None, "z")], "doc_id long, quality int, toxic int, text string")
    got = quality_rules.quality_rules(frame(spark, rows), labels).collect()
    assert len(got) == len(rows)
    want = collections.Counter((i, *plain_counts(t)) for i, t in rows)
    assert collections.Counter(tuple(r)[:6] for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality_rules.THRESHOLD)
    kept = quality_rules.accepted(frame(spark, rows), labels)
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter(r["doc_id"] for r in got if r["kept"])


def test_quality_score_is_the_mean_log_ratio(spark):
    good = [(i, " ".join(random.Random(i).choices(["alpha", "beta", "gamma"], k=40))) for i in range(20)]
    junk = [(100 + i, " ".join(random.Random(i).choices(["ALPHA!!", "x***", "|"], k=40))) for i in range(20)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(frame(spark, good + junk), labels).collect()}
    raw, target = collections.Counter(), collections.Counter()
    from tidelog.llm import textkit as tk

    def cells(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return quality_rules.cells(*tk.words(data, np.array([0, len(data)]))[:2], quality_rules.BUCKETS)[0].tolist()

    for i, t in good + junk:
        raw.update(cells(t))
        target.update(cells(t) if i < 10 else [])
    scale, k = sum(target.values()) / sum(raw.values()), quality_rules.SMOOTHING
    for i, t in good + junk:
        own = cells(t)
        mean = sum(np.log((target[c] + k) / (raw[c] * scale + k)) for c in own) / len(own)
        assert got[i]["score"] == pytest.approx(mean, abs=1e-8)
    assert min(got[i]["score"] for i, _ in good) > max(got[i]["score"] for i, _ in junk)  # held-out ones among them


def test_verdicts_on_labels_that_the_target_does_not_hold(spark):
    """The threshold keeps good texts and rejects bad ones of which the trusted sample knows nothing."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(docs, labels.where("doc_id % 2 = 0")).collect()}
    of = lambda quality: [kept[r["doc_id"]] for r in labels.where(f"doc_id % 2 = 1 and quality = {quality} and coalesce(toxic, 0) = 0").collect()]
    good, bad = of(1), of(0)
    assert sum(good) >= 0.95 * len(good) > 50 and sum(bad) <= 0.1 * len(bad) and len(bad) > 10


def test_empty_tables(spark):
    none = frame(spark, []).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert quality_rules.quality_rules(none, labels).count() == 0
    assert lm_scoring.lm_scoring(none, labels).count() == 0
    assert license_scan.license_scan(none).count() == 0
    assert personal_data.personal_data(none).count() == 0
    assert decontamination.contamination(none, items).count() == 0
    assert packing.best_fit_packing(none).count() == 0
    assert decontamination.decontaminated(frame(spark, ODD), items).count() == len(ODD)


# language-model scores


def test_lm_scores_separate_held_out_texts(spark):
    good = [(i, " ".join(random.Random(i).choices("river stone lamp oak tide north".split(), k=60))) for i in range(40)]
    junk = [(100 + i, " ".join(random.Random(i).choices("zz qq xx vv kk jj".split(), k=60))) for i in range(40)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in lm_scoring.lm_scoring(frame(spark, good + junk + ODD), labels).collect()}
    assert len(got) == 80 + len({i for i, _ in ODD})
    assert max(got[i]["score"] for i in range(20, 40)) < min(got[i]["score"] for i, _ in junk)
    assert got[900]["n_tokens"] == 0 and got[900]["score"] is None and got[905]["n_tokens"] == 160
    for r in got.values():
        if r["n_tokens"]:
            assert r["score"] == pytest.approx(r["target_loss"] - r["background_loss"], abs=1e-8)


def plain_losses(rows, good, prior, added):
    """Losses of each row by models of all other rows' tokens."""
    one, two, contexts = ([collections.Counter(), collections.Counter()] for _ in range(3))
    own = []
    for i, t in rows:
        w = words(t)
        own.append((i in good, w, collections.Counter(w), collections.Counter(zip(["<s>", *w], w, strict=False)), collections.Counter(["<s>"] if w else [])))
        for part, counts in zip((one, two, contexts), own[-1][2:], strict=True):
            part[i in good].update(counts)
    vocabulary = len(one[0] + one[1] + contexts[0] + contexts[1])
    out = []
    for kind, w, one_own, two_own, start_own in own:
        models = [[one[k] - one_own, two[k] - two_own, contexts[k] - start_own] if k == kind else [one[k], two[k], contexts[k]] for k in (True, False)]
        models = [m if m[0] else models[1 - k] for k, m in enumerate(models)]
        sizes, found = [m[0].total() for m in models], []
        for m, scale in zip(models, (1, sizes[0] / max(sizes[1], 1)), strict=True):
            loss = 0
            for v, x in zip(["<s>", *w], w, strict=False):
                single = (m[0][x] * scale + added) / (sizes[0] + added * (vocabulary + 1))
                loss -= np.log((m[1][v, x] * scale + prior * single) / ((m[2][v] if v == "<s>" else m[0][v]) * scale + prior))
            found.append(loss / len(w) if w else None)
        out.append((len(w), *found))
    return out


@pytest.mark.parametrize(("chunk", "bucket"), [(8 << 20, 1 << 20), (300, 50)])
def test_lm_losses_against_plain_counts(spark, chunk, bucket):
    rows = some_texts(190) + ODD
    good = set(range(0, 190, 3)) | {905}
    labels = spark.createDataFrame([(i, 1, 0) for i in good] + [(None, 1, 0), (1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = collections.defaultdict(list)
    for r in lm_scoring.lm_scoring(frame(spark, rows).repartition(5), labels, chunk, bucket, 2.0, 0.5).collect():
        got[r["doc_id"]].append(tuple(r)[1:])
    assert sum(map(len, got.values())) == len(rows)
    for (i, _), (n, target, rest) in zip(rows, plain_losses(rows, good, 2.0, 0.5), strict=True):
        r = got[i][0]
        assert r[0] == n and (n == 0) == (r[3] is None)
        if n:
            assert r[1:] == pytest.approx((target, rest, target - rest), abs=1e-7), i


def test_lm_without_targets(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in lm_scoring.lm_scoring(frame(spark, [(1, "a b"), (2, "b c"), (3, "")]), labels).collect()} == {0.0, None}


# licences


def plain_licence(text):
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = sorted((k, label) for phrase, label in license_scan.BASE for k in range(len(own)) if own[k : k + len(phrase.split())] == phrase.split())
    ends = (places[0][0], places[-1][0]) if places else (None, None)
    return len(own), len(places), *ends, ",".join(sorted({label for _, label in places}))


def test_license_scan(spark):
    rows = [(1, "Released under the MIT License. under the mit license"), (2, "CC-BY-NC; cc by nc 4.0, Licensed under CC BY-NC 4.0"), (3, "under the mit"), (4, "apache license version 2")]
    rows += [(5, "This work is licensed under the GNU General Public License, version 3."), (6, "GNU general license"), (7, "café MIT under the mit license é"), (8, "the licence of the " * 500), (9, "K cc by nc")]
    rows += [(10 + i, " ".join(random.Random(i).choices("under the mit license apache version 2 cc by nc".split(), k=40))) for i in range(40)] + ODD
    got = license_scan.license_scan(frame(spark, rows)).collect()
    assert collections.Counter(tuple(r)[:6] for r in got) == collections.Counter((i, *plain_licence(t)) for i, t in rows)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[5]["labels"] == "gpl-3" and by_id[5]["score"] == 1 and by_id[6]["labels"] == "" and "cc-by-nc-4" in by_id[2]["labels"].split(",")
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    plan = license_scan.license_scan(frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_licences_in_a_megabyte_of_phrases(spark):
    began = time.monotonic()
    rows = [(1, "under the mit license " * 45_000), (2, "mit " * 250_000), (3, "cc by nc 4 0 " * 80_000)]
    got = {r["doc_id"]: r for r in license_scan.license_scan(frame(spark, rows)).collect()}
    assert [got[i]["n_base"] for i in (1, 2, 3)] == [45_000, 0, 80_000] and got[1]["last_word"] == 4 * 44_999
    assert time.monotonic() - began < 120


# personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and personal_data.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            out += [(kind, *m.span())] if good else []
    return out


def test_personal_data(spark):
    random.seed(2)
    rows = some_texts() + ODD + [(1000 + i, "".join(random.choice("a1.2@-+ (:/é4") for _ in range(random.randint(0, 60)))) for i in range(1500)]
    rows += [(3000, 'token = "04dbebab91ab85687d33ee" see https://x.org/a?b=1. IBAN: DE89 3704 0044 0532 0130 00'), (3001, "1" * 5000), (3002, "1.2." * 3000), (3003, "a" * 5000 + "@")]
    got = personal_data.personal_data(frame(spark, rows)).collect()
    want = collections.Counter()
    for i, t in rows:
        base = plain_spans(t)
        counts = [sum(k == kind for k, _, _ in base) for kind in PATTERNS]
        want[i, *counts, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r)[:6] for r in got) == want
    spans = next(r["spans"] for r in got if r["doc_id"] == 3000)
    assert [s.split(":")[0] for s in spans.split(",")] == ["iban", "secret", "url"]


def test_texts_of_a_megabyte_in_linear_time():
    for text in ("token=" * 170_000, "1.2." * 250_000, "4111 " * 200_000, "a@" * 500_000, "://x" * 250_000, "+1" * 500_000, "iban DE" * 140_000, "token = " + "a" * 1_000_000, "x://" * 250_000):
        began = time.monotonic()
        personal_data.spans(text)
        assert time.monotonic() - began < 20, text[:20]


# archives


def test_archives_round_trip(spark):
    random.seed(3)
    magic, rows = web_archive.MAGIC, []
    for i in range(80):
        fake = f"a{i}\r\n\r\n{magic}WARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: {random.choice([3, 5, 40, 0, 10**12])}\r\n\r\nabc\r\n\r\n" * random.randint(1, 3)
        html = [None, "", f"x{i}" * random.randint(1, 80), magic, fake + "é€", "\r\n\r\n" + magic * (i % 4), "same " * 40, "\r\n"][i % 8]
        rows.append((i - 5, f"http://u/{i}\r\nWARC-Type: fake", html, "z"))
    rows += [(None, "u", "no id", "z"), (None, "u", "no id", "z"), (200, None, "same " * 40, "z"), (None, None, "same " * 40, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    first, want = {}, collections.Counter()
    for i, _, html, _ in rows:
        if i is not None:
            first.setdefault(html or "", i)
    for i, _, html, _ in rows:
        data, least = (html or "").encode(), first.get(html or "")
        again = least is not None and least != i
        want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", least if again else None] += 1
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in ("300", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            assert collections.Counter(map(tuple, web_archive.archived(pages).collect())) == want
        assert web_archive.archived(pages.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


# benchmark items


def test_decontamination(spark):
    random.seed(6)
    vocabulary = [f"w{i}" for i in range(400)]
    line = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    items = [(i, line(random.choice([1, 3, 4, 5, 8, 20, 40]))) for i in range(40)] + [(77, None), (78, ""), (None, line(9)), (3, line(12))]
    rows = []
    for i in range(120):
        own = random.choice(items)[1] or ""
        parts = own.split()
        for _ in range(random.choice([0, 0, 1, 2])):
            if parts:
                parts[random.randrange(len(parts))] = random.choice(vocabulary)
        cut = random.choice([0, 0, 1])
        rows.append((i, " ".join([line(random.choice([0, 5, 30])), " ".join(parts[cut:]).upper() if i % 3 else ", ".join(parts), line(random.choice([0, 9]))])))
    rows += ODD
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    own_items = [(i, split(t)) for i, t in items]
    df = collections.Counter(g for _, w in own_items for g in grams(w))
    weight = lambda g: round(1000 * np.log1p(len(own_items) / df[g])) if g in df else round(1000 * np.log1p(len(own_items)))
    total = lambda s: sum(map(weight, s))
    want = []
    for i, t in rows:
        w, found = split(t), set()
        for item, words_ in own_items:
            n = len(words_)
            for p in range(max(1, len(w) - n + 1)) if n and w else ():
                a, b = grams(w[p : p + n]), grams(words_)
                if total(a & b) >= 0.8 * total(a | b):
                    found.add(item)
        want.append((i, tuple(sorted(found - {None})) + (None,) * (None in found)))
    assert any(None in f for _, f in want)
    for block in (1024, 7):  # weights are of all items, however they are split
        blocks = decontamination.contamination(frame(spark, rows), benchmark, block_items=block).collect()
        assert collections.Counter((r["doc_id"], tuple(r["item_ids"])) for r in blocks) == collections.Counter(want)
    got = [(r["doc_id"], tuple(r["item_ids"])) for r in decontamination.contamination(frame(spark, rows), benchmark).collect()]
    assert collections.Counter(got) == collections.Counter(want) and any(f for _, f in want)
    kept = decontamination.decontaminated(frame(spark, rows), benchmark)
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter(i for i, f in want if not f)


# packing


def test_ids_are_the_tokenizers(spark, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t or "" for _, t in some_texts() + ODD] + ["it's  two\n\n lines \r\n x", "日本語   x \x1c\x85", "<|endoftext|> a", "don'T 12ab ½ ¡hola!", "𝒳 ​ ź"]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    monkeypatch.setattr(packing, "REMEMBERED", 5000)  # so that parts are forgotten and encoded again
    for text in texts:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packing.encode(text), "<u4").tolist() == ids


def test_parts_that_come_again_stay_remembered(monkeypatch):
    """Before, all parts were forgotten when they were too many, and common ones were encoded once more."""
    monkeypatch.setattr(packing, "REMEMBERED", 400)
    encoder, made = packing.Encoder(None), []
    real = encoder.tokenizer

    class Counting:
        def tokenize(self, part):
            made.append(part)
            return real.model.tokenize(part)

    encoder.known.model = Counting()
    common = " ".join(f"common{chr(97 + i)}" for i in range(20))
    for i in range(200):
        text = f"{common} " + " ".join(f"rare{chr(97 + i // 26)}{chr(97 + i % 26)}{chr(97 + j)}" for j in range(10))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == real.encode(text, add_special_tokens=False).ids
        assert len(encoder.known) + len(encoder.known.before) <= 400 + 2 * 30
    assert sum("rare" in p for p in made) == 2000 and sum("common" in p for p in made) == 20


def test_packing(spark):
    rows = some_texts(200) + ODD + [(5000, "word and more " * 3000)]
    got = packing.best_fit_packing(frame(spark, rows), group_size=32).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
        assert sum(r["length"] for r in own) <= 1024
    for i, t in rows:
        if i == 904:
            continue  # twice the same document
        ids = packing.encode(t or "") + np.array([2], "<u4").tobytes()
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids) // 4
        assert all(r["length"] == 1024 for r in own[1:])
        for r in own:
            assert zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"]
    assert len(by_doc[904]) == 2 and len(by_doc) == len({i for i, _ in rows})
    bound = packing.lower_bound(np.array([r["length"] for r in got]), 1024)
    assert bound <= len(by_sequence) <= bound + 2


def test_bounds_and_fit_against_brute_force():
    def best(sizes, capacity):
        from functools import cache

        @cache
        def need(rest):
            if not rest:
                return 0
            out, n = len(rest), len(rest) - 1
            for mask in range(1 << n):
                own = [rest[0]] + [rest[i + 1] for i in range(n) if mask >> i & 1]
                if sum(own) <= capacity:
                    out = min(out, 1 + need(tuple(rest[i + 1] for i in range(n) if not mask >> i & 1)))
            return out

        return need(tuple(sizes))

    for seed in range(40):
        rng = random.Random(seed)
        sizes = sorted((rng.randint(1, 12) for _ in range(7)), reverse=True)
        where, offset, left = packing.best_fit_decreasing(sizes, 12)
        least = best(sizes, 12)
        assert packing.lower_bound(np.array(sizes), 12) <= least <= len(left)
        for b in range(len(left)):
            assert 12 - left[b] == sum(s for s, w in zip(sizes, where, strict=True) if w == b)
        assert sorted(zip(where, offset, strict=True)) == sorted(set(zip(where, offset, strict=True)))


def test_extra_columns_do_not_matter(spark):
    plain = spark.createDataFrame([(i, t) for i, t in ODD], "doc_id long, text string")
    both = personal_data.personal_data(plain).unionByName(personal_data.personal_data(frame(spark, ODD)))
    assert both.groupBy("doc_id", "spans").agg(F.count("*").alias("n")).where("n % 2 = 1").count() == 0
