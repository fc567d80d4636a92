"""Each training-data operator on small tables with awkward rows, against plain Python."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from treecensus.llm import (
    decontamination, language, licenses, near_duplicates, packing, pii, quality, token_counts, token_files, tokens, top_k,
)
from treecensus.llm.common import folder, importable, settle

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          "row string, spans string, k1 string, component string, digest string, length string")
LONG = " ".join(f"word{i % 700}" for i in range(9000))
BASE = " ".join(f"alpha{i} beta{i}" for i in range(40))
TEXTS = [
    (1, "It's <|endoftext|> a naïve  test,\n\n two\tthree 12 345 &&& İstanbul"), (2, None), (3, ""), (4, LONG), (5, BASE), (6, BASE),
    (6, BASE), (None, BASE), (7, BASE.replace("alpha3 ", "gamma ")), (8, "x"), (9, "日本語 テキスト ｆｕｌｌ é"), (10, "12 34 ... !!"),
    (11, "   \n\t "),
]


@pytest.fixture(scope="module")
def documents(spark):
    importable(spark)
    rows = [(i, t, "en", "s", len(t or ""), "r", "s", "k", "c", "d", "l") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    importable(spark)
    return spark.createDataFrame([], SCHEMA)


def bag(frame, *names):
    return sorted((tuple(r[n] for n in names) for r in frame.select(*names).collect()), key=repr)


def test_ids_equal_the_library_for_every_plain_character():
    plain = [chr(c) for c in range(0x250) if tokens.PLAIN.fullmatch(chr(c))]
    draw = random.Random(3)
    texts = [a + b + "x" for a in plain for b in draw.sample(plain, 4)]
    texts += ["".join(draw.choices(plain + ["'s", "'LL", "  ", "\n ", "<|endoftext|>"], k=60)) for _ in range(300)]
    texts += [t for _, t in TEXTS if t]
    for path in (WORDS, BYTES):
        library, own = Tokenizer.from_file(path), tokens.Encoder(path)
        for text in texts:
            ids = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(own.encode(text), "<u4").tolist() == ids, text
            parts = own.parts(text)
            assert len(parts) // 2 + sum(len(own.ids_of(w)) for p in parts[::2] for w in own.split(p)) == len(ids), text


def test_token_counts(documents, none):
    library = Tokenizer.from_file(WORDS)
    want = sorted(((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048)
                   for i, t in TEXTS), key=repr)
    for frequent in (1 << 17, 3):  # all known ahead, and nearly all by the join
        got = token_counts.token_counts(documents, WORDS, frequent=frequent)
        assert bag(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.token_counts(none, WORDS).count() == 0


def test_packing(documents, none):
    library = Tokenizer.from_file(BYTES)
    rows = packing.pack(settle(packing.cut(documents, BYTES), "pieces")).collect()
    want = sorted(tuple(library.encode(t or "", add_special_tokens=False).ids + [0]) for _, t in TEXTS)
    whole, places = {}, {}
    for r in sorted(rows, key=lambda r: (r.row, r.piece)):
        assert r.start == len(whole.setdefault(r.row, [])) and (r.piece == 0 or r.length == 2048)
        whole[r.row] += np.frombuffer(r.ids, "<u4").tolist()
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(map(tuple, whole.values())) == want
    for parts in places.values():
        ends = np.cumsum([0] + [n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= 2048
    assert len(places) == -(-sum(map(len, want)) // 2048)
    assert packing.pack(settle(packing.cut(none, BYTES), "pieces")).count() == 0


def test_a_plan_uses_each_length_once():
    draw = random.Random(1)
    lengths = [draw.choice([draw.randint(1, 2048), 700, 1300]) for _ in range(4000)]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    used = {}
    plan = packing.fit(histogram)
    for pattern, n in plan:
        assert sum(a * m for a, m in pattern) <= 2048
        for a, m in pattern:
            used[a] = used.get(a, 0) + m * n
    assert used == histogram
    assert sum(n for _, n in plan) <= 1.02 * max(sum(lengths) / 2048, sum(a > 1024 for a in lengths))


def test_sequences_hold_the_ids(spark, documents):
    packed = packing.pack(settle(packing.cut(documents, BYTES), "pieces"))
    assert packing.sequences(packed).agg(F.sum("n_ids"), F.sum(F.length("ids") / 4)).first()[:] == \
        tuple([packed.agg(F.sum("length")).first()[0]] * 2)


def test_codes_round_trip():
    draw = np.random.default_rng(5)
    lists = [draw.integers(0, 1 << int(draw.integers(1, 32)), int(draw.integers(0, 50)), dtype=np.uint64).astype(np.uint32) for _ in range(200)]
    control, data = zip(*map(token_files.compress, lists))
    got = token_files.expand(b"".join(control), b"".join(data), np.array([len(x) for x in lists]))
    assert np.array_equal(got, np.concatenate(lists))
    counts = np.array([len(x) for x in lists])
    whole, control_ends, bytes_, data_ends = token_files.compress_all(np.concatenate(lists), counts)
    assert whole.tobytes() == b"".join(control) and bytes_.tobytes() == b"".join(data)
    assert control_ends.tolist() == np.cumsum([len(x) for x in control]).tolist()
    assert data_ends.tolist() == np.cumsum([len(x) for x in data]).tolist()


@pytest.mark.parametrize("shard", [1 << 23, 2000])
def test_token_files(spark, documents, none, shard):
    library, path = Tokenizer.from_file(WORDS), folder(spark, "token-files")
    token_files.write(documents, path, WORDS, 2, shard)
    rows = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((i for i, _ in TEXTS), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    want = sorted((i or 0, library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in TEXTS)
    assert sorted((r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == want


def test_token_files_of_nothing(spark, none):
    path = folder(spark, "token-files")
    token_files.write(none, path, WORDS)
    assert token_files.read(spark, path).count() == 0


def test_network_gradients_agree_with_differences():
    net = language.Network(["a", "b"], hidden=3)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    data, labels = np.random.default_rng(1).integers(0, 256, (6, 4)), np.array([0, 1, 1, 0])
    _, slopes = net.gradients(data, labels)
    for k in ("fgates", "bcand", "bout", "bias"):
        at = tuple(0 for _ in net.weights[k].shape)
        losses = []
        for step in (1e-3, -2e-3):
            net.weights[k][at] += step
            losses.append(net.gradients(data, labels)[0])
        net.weights[k][at] += 1e-3
        assert abs((losses[0] - losses[1]) / 2e-3 - slopes[k][at]) < 1e-3


def test_language(spark, documents, none):
    draw = random.Random(2)
    kinds = {"aa": "the of and this there".split(), "bb": "der und eine nicht über".split()}
    rows = [(i, " ".join(draw.choices(kinds[k], k=30)), k) for i in range(300) for k in [draw.choice(["aa", "bb"])]]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    net = language.fit(table, ~language.held_out(F.col("doc_id")), rounds=60)
    got = language.predict(table.withColumn("score", F.lit("old")), net).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98 and all(0 <= r.score <= 1 for r in got)
    held = {r.doc_id: r.h for r in table.select("doc_id", language.held_out(F.col("doc_id")).alias("h")).collect()}
    assert held == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in held}
    odd = {r.text: r.lang_pred for r in language.predict(documents, net).collect()}
    assert [odd[t] for t in (None, "", "12 34 ... !!", "   \n\t ")] == ["und"] * 4 and odd["x"] in kinds
    assert language.predict(none, net).count() == 0 and language.fit(none, F.lit(True)) is None


def test_strangeness_equals_a_plain_count(spark):
    draw = np.random.default_rng(5)
    windows = draw.choice(np.frombuffer(b"abc de\n", np.uint8), (40, 32))
    labels = np.arange(40) % 2
    pairs = language.Pairs(windows, labels, 2)
    texts = [b"abc", b"", b"x", "Жук ab".encode(), b"12 34", b"a1b2", b"ABC de abc"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = pairs.strangeness(data, offsets, np.array([[0, 1]] * len(texts)))
    letter = lambda b: 97 <= b <= 122 or b >= 128
    for text, found in zip(texts, got):
        low = text.lower()
        counted = [(a, b) for a, b in zip(low, low[1:]) if letter(a) and letter(b) or letter(a) and b in b" \n" or letter(b) and a in b" \n"]
        least = 0.0
        if counted:
            n = len(counted)
            least = min(sum(float(pairs.surprise[k][a * 256 + b]) for a, b in counted) / n
                        / (pairs.limit[k] + pairs.ROOM * pairs.spread[k] / n ** 0.5) for k in (0, 1))
        assert abs(found - least) < 1e-4


def test_sample_is_bounded_and_teaches_a_repeated_row_once(spark):
    rows = [(i, f"text number {i}", "aa") for i in range(3000)] + [(1, "same text", "aa")] * 2000 + [(9, "other words", "bb"), (8, "x", "cc")] * 3
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    names, windows, labels = language.sample_windows(table, F.lit(True), 100, 32)
    again = language.sample_windows(table, F.lit(True), 100, 32)
    assert names == ["aa", "bb", "cc"] and np.bincount(labels).tolist() == [100, 1, 1]
    assert np.array_equal(windows, again[1]) and len({w.tobytes() for w in windows[labels == 0]}) > 95
    ordered = sorted({(r.h, r.text) for r in table.where("lang = 'aa'").select(F.xxhash64("text", "doc_id").alias("h"), "text").collect()},
                     key=lambda r: r[0] % (1 << 64))[:100]
    assert len(ordered) == 100  # candidates lie in one range of hashes, so ranks do not depend on partitions
    assert language.sample_windows(table, F.lit(True), 100, 32, most=1)[0] == ["aa"]


def test_a_text_is_pooled_alike_alone_and_in_company():
    net = language.Network(["a", "b", "c"])
    texts = [b"x", b"hello world" * 40, b"q" * 128, b"ab" * 100]
    together = net.pooled(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    for i, text in enumerate(texts):
        assert np.allclose(net.pooled(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0], together[i], atol=1e-5)
        assert abs(together[i].sum() - 1) < 1e-4


def linked(a, b):
    sets = []
    for text in (a, b):
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return bool(sets[0] and sets[1]) and 100 * len(sets[0] & sets[1]) >= 75 * len(sets[0] | sets[1])


def test_near_duplicates(spark, documents, none):
    draw, rows = random.Random(4), list(TEXTS)
    for family in range(4):  # copies with more and more edits, so that groups hang together by chains
        words = [f"f{family}w{draw.randint(0, 500)}" for _ in range(120)]
        for k in range(40):
            own = list(words)
            for _ in range(draw.randint(0, 9)):
                own[draw.randrange(120)] = f"edit{draw.randint(0, 99)}"
            rows.append((100 + family * 40 + k, " ".join(own)))
    table = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id bigint, text string, component string")
    named = [(i, t) for i, t in rows if i is not None]
    parent = {i: i for i, _ in named}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, a) in enumerate(named):
        for j, b in named[:n]:
            if top(i) != top(j) and linked(a, b):
                low, high = sorted((top(i), top(j)))
                parent[high] = low
    want = sorted(((i, None if i is None else top(i)) for i, _ in rows), key=repr)
    got = near_duplicates.near_duplicates(table)
    assert bag(got, "doc_id", "component_id") == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got.collect())
    assert near_duplicates.near_duplicates(none).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.component for r in near_duplicates.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}}


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(n - 9 if n > 9 else n for n in twice) % 10 == 0


def expected(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                    "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


def test_pii(spark, documents, none):
    draw = random.Random(6)
    bits = ["a", "b.c", "@", ".", "-", "+", " ", "%", "1", "22", "255", "256", "007", "4111 1111 1111 1111", "4111-1111-1111-1112",
            "x@y.z", "+1 (555) 123-4567", "10.0.0.1", "é", "𝒳", "\n", "(", ")", "_"]
    texts = ["".join(draw.choices(bits, k=draw.randint(1, 25))) for _ in range(600)] + [
        "a" * 50000, "1" * 50000, "1." * 20000, "+1 " + "(" * 30000, "a@" + "b." * 20000, None, "", "x@y.z " * 2000]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    base = {k.name for k in pii.KINDS if k.base}
    found = settle(pii.find(table), "spans")
    for r in found.collect():
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind in base] == expected(r.text), r.text
        assert all(s.value == r.text[s.start:s.end] for s in r.spans)
    for r in pii.redact(found).where("size(spans) > 0").collect():
        keep = [True] * len(texts[r.doc_id])
        for s in r.spans:
            keep[s.start:s.end] = [False] * (s.end - s.start)
        assert re.sub("<(?:email|ip|card|phone|iban|ssn|secret)>", "", r.text) == "".join(c for c, k in zip(texts[r.doc_id], keep) if k)
    extra = spark.createDataFrame([("account GB82 WEST 1234 5698 7654 32 ok",), ("account GB82 WEST 1234 5698 7654 33 ok",),
                                   ("my ssn is 123-45-6789",), ("code 123-45-6789",), ("password=hunter2hunter2",)], "text string")
    assert [[s.kind for s in r.spans] for r in pii.find(extra).collect()] == [["iban"], [], ["ssn"], [], ["secret"]]
    assert pii.find(none).count() == 0 and pii.find(documents).count() == len(TEXTS)


def test_a_secret_is_found_whole_however_long(spark):
    values = ["".join(random.Random(n).choices("abcXYZ019+/=._-", k=n)) for n in (7, 8, 200, 201, 330, 5000, 20000)]
    texts = [f"before token={v} after" for v in values] + ["password: '" + "p" * 4000 + "', next", "token=" * 20000]
    rows = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    got = {r.doc_id: r for r in pii.redact(rows.withColumn("found", F.transform("spans", lambda s: s["value"]))).collect()}
    assert got[0].found == [] and got[0].text == texts[0]
    for i, v in list(enumerate(values))[1:]:
        assert got[i].found == [f"token={v}"] and got[i].text == "before <secret> after"
    assert got[len(values)].text == "<secret>', next" and got[len(values) + 1].text == "<secret>"


def test_decontamination(spark, documents, none):
    draw = random.Random(8)
    vocabulary = [f"W{i}" for i in range(30)] + ["the", "Ünï", "of"]
    say = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    items = [(1, " ".join(say(30))), (2, "Only four words here"), (3, None), (4, "..."), (None, " ".join(say(14)))]
    items += [(5, items[0][1]), (10, " ".join(say(13)))]
    rows = list(TEXTS)
    for i in range(60):
        text = say(draw.randint(5, 80))
        for _ in range(draw.randint(0, 2)):
            part = (draw.choice(items)[1] or "").split()
            a = draw.randint(0, 5)
            text[draw.randint(0, len(text)):0] = part[a:a + draw.randint(4, 30)]
        rows.append((100 + i, ", ".join(text)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    tests = spark.createDataFrame(items, "item_id bigint, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    windows = {}
    for i, t in items:
        w = split(t)
        for a in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[a:a + 13]), set()).update([] if i is None else [str(i)])
    want = []
    for i, t in rows:
        w, hit, named = split(t), set(), set()
        for a in range(len(w)):
            for n in {len(x) for x in windows}:
                if tuple(w[a:a + n]) in windows:
                    hit.update(range(a, a + n))
                    named |= windows[tuple(w[a:a + n])]
        want.append((i, len(w), len(hit), sorted(named), len(hit) > 0 and 20 * len(hit) >= len(w)))
    got = decontamination.contamination(table, tests)
    assert bag(got, "doc_id", "n_words", "n_hit", "items", "contaminated") == sorted(want, key=repr)
    assert decontamination.contamination(none, tests).count() == 0
    assert {r.n_hit for r in decontamination.contamination(documents, tests.limit(0)).collect()} == {0}


def test_proximity(spark):
    table = spark.createDataFrame([(1, "rare one two three unique"), (2, "rare one unique"), (3, "rare x x x x x x x x x x unique")],
                                  "doc_id bigint, text string")
    phrases, _ = decontamination.windows(spark.createDataFrame([(1, "rare one two unique")], "item_id bigint, text string"))
    terms = phrases.select(F.explode("words").alias("w")).select(F.xxhash64("w").alias("term"))
    postings = decontamination.index(table, terms)
    near = decontamination.near_matches(phrases, postings, slop=2).join(decontamination.keyed(table), ["k1", "k2"])
    assert {r.doc_id for r in near.collect()} <= {1, 2} and near.count() >= 1


def test_licenses(spark, documents, none):
    filler = " ".join(f"w{i}" for i in range(300))
    texts = [(i, f"{filler} {text}\n{filler}", name) for i, (name, text) in enumerate(licenses.TEMPLATES)]
    texts += [(90, filler, None), (91, None, None), (92, "Released under the", None)]
    got = licenses.scan(spark.createDataFrame([t[:2] for t in texts], "doc_id int, text string")).collect()
    for i, _, name in texts:
        assert (name is None) == (not [r for r in got if r.doc_id == i]) and (name is None or name in {r.license for r in got if r.doc_id == i})
    assert licenses.scan(documents).count() == 0 and licenses.scan(none).count() == 0


def test_quality(spark, documents, none):
    draw = random.Random(9)
    rows, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        text = " ".join(draw.choices(["Good", "words", "flow", "here."] if good else ["$$$", "win%%", "###", "buy"], k=20))
        rows.append((i, text, "en", "good" if good else draw.choice(["bad", "good"]), len(text)))
        if i % 2:
            labels.append((i, int(good)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    marks = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id bigint, quality int")
    got = quality.score(table, quality.fit(table, marks)).collect()
    assert np.mean([r.kept == (r.doc_id % 3 > 0) for r in got]) > 0.97
    assert quality.score(documents, None).where("kept").count() == len(TEXTS)
    assert quality.fit(none, marks) is None and quality.score(none, None).count() == 0


def test_quality_learns_from_ids_and_not_from_their_copies(spark):
    importable(spark)
    rows = [(i, f"text {i}", "en", "s", 6) for i in range(40)] + [(0, f"copy {i % 3}", "en", "s", 6) for i in range(500)]
    rows += [(None, "no id", "en", "s", 5)] * 30
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5)
    marks = spark.createDataFrame([(i, int(i % 4 > 1)) for i in range(20)], "doc_id bigint, quality int")
    seen = settle(quality.views(table), "views")
    for labelled in (20, 16):
        taken = []
        for again in range(2):
            sample, rest = quality.split(seen, marks, labelled)
            got = sample.toPandas()
            assert len(got) == got.doc_id.nunique() == labelled
            taken.append(got.sort_values("doc_id")[["doc_id", "h"]].values.tolist())
            # rows outside the sample, equal ones once: other ids, the row without one, and copies under 0 unless 0 is in the sample
            assert rest.count() == 40 - labelled + 1 + (0 if 0 in set(got.doc_id) else 3)
        assert taken[0] == taken[1]


def quality_pages(count, labelled, seed=3):
    """Pages whose words tell their quality, half of the bad ones from a source of their own; a part is labelled."""
    draw, rows = random.Random(seed), []
    for i in range(count):
        good = draw.random() < 0.8
        words = draw.choices([f"good{k}" for k in range(60)] if good else [f"bad{k}" for k in range(60)], k=12)
        words += draw.choices([f"word{k}" for k in range(200)], k=20)
        rows.append((i, " ".join(words) + ("." if good else "\n" * 9), "en", "farm" if not good and draw.random() < 0.5 else "web", 200))
    return rows, [(i, int("good" in rows[i][1])) for i in range(0, count, count // labelled)]


def test_quality_on_rows_it_has_not_learnt_from(spark):
    rows, labels = quality_pages(1500, 100)
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    got = quality.judge(table, spark.createDataFrame(labels, "doc_id bigint, quality int")).toPandas()
    new = got[~got.doc_id.isin([i for i, _ in labels])]
    truth = np.array(["good" in rows[i][1] for i in new.doc_id])
    right = {c: ((new[c] >= 0.5) == truth).mean() for c in ("p_text", "p_meta", "score")}
    assert len(got) == 1500 and right["score"] >= max(right["p_text"], right["p_meta"]) - 0.005 and right["score"] > 0.98
    assert ((new.score >= 0.5) == truth)[~truth].mean() > 0.95


def test_pseudo_labels_come_from_all_rows_and_equal_plain_sums(spark):
    rows, labels = quality_pages(700, 70)
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4)
    seen = settle(quality.views(table), "views")
    sample, rest = quality.split(seen, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    known, pool = sample.orderBy("doc_id").toArrow(), settle(rest, "pool")
    good = np.array(known["quality"].to_pylist())
    models = [quality.ratio(quality.summed(known, good, v), 0, np.bincount(good), np.zeros(2)) for v in ("text", "meta")]
    plain = pool.toArrow().combine_chunks().to_batches()[0]
    steps = [quality.stepped(o) for o in quality.odds_of(plain, *models)]
    counts = quality.steps_of(pool, *models)
    assert counts == [dict(zip(*map(np.ndarray.tolist, np.unique(s, return_counts=True)))) for s in steps]
    limits = [quality.thresholds(c, 0.4, 0.8) for c in counts]
    n = plain.num_rows
    reached = [((s <= low).sum(), (s >= high).sum(), (s < 0).sum(), (s > 0).sum()) for s, (low, high) in zip(steps, limits)]
    for low, high, below, above in reached:
        assert n > 600 and low >= min(0.08 * n, below) and high >= min(0.32 * n, above), reached
    for told, view, by in zip(quality.told_by(pool, *models, limits), ("text", "meta"), (1, 0)):
        up, sure = (steps[by] >= limits[by][1]).astype(int), (steps[by] <= limits[by][0]) | (steps[by] >= limits[by][1])
        assert told.rows.tolist() == np.bincount(up[sure], minlength=2).tolist()
        expected = np.zeros_like(getattr(told, view))
        for row, u, s in zip(plain.to_pylist(), up, sure):
            for k, at in enumerate(row[f"{view}_at"] if s else ()):
                expected[u, at] += row["text_value"][k] if view == "text" else quality.UNIT
        assert np.array_equal(getattr(told, view), expected)


def test_thresholds():
    assert quality.thresholds({-5: 2, -3: 2, -1: 6, 2: 6, 4: 4}, 0.5, 0.5) == (-1, 2)
    assert quality.thresholds({-5: 2, -3: 2, -1: 6, 2: 6, 4: 4}, 0.2, 0.5) == (-5, 4)
    edge = quality.REACH * quality.STEP + 1
    assert quality.thresholds({}, 0.5, 0.5) == (-edge, edge) and quality.thresholds({0: 9}, 0.5, 0.5) == (-edge, edge)


def test_quality_sees_every_character_of_a_text_without_spaces():
    draw = random.Random(12)
    for letters in ("日本語文字列試験東京都市", "abcXYZ019+/="):
        text = "".join(draw.choices(letters, k=400))
        whole = quality.text_view(text)
        assert all(quality.text_view(text[:i] + "ß" + text[i + 1:]) != whole for i in range(400))
        seen = quality.counted(text)
        assert seen.total() == 398 and all(g in text for g in seen)
    assert quality.counted("so it is, it is") == {"so": 1, "it": 2, "is,": 1, "is": 1}

    start, rows = "始" * 40, []
    for i in range(80):
        letters = "良文章読書明快" if i % 2 else "買安賣錢速得今"
        rows.append((start + "".join(draw.choices(letters, k=300)) + "終終終終", i % 2 == 1))
    x, y = quality.dense([quality.text_view(t) for t, _ in rows], quality.TEXT), np.array([g for _, g in rows])
    model = quality.logistic(x[:40], y[:40])
    assert ((model.odds(x[40:]) > 0) == y[40:]).all()


@pytest.mark.parametrize("size,spread", [(4, 0.05), (16, 1.0)])
def test_top_k(spark, size, spread):
    draw = np.random.default_rng(3)
    centers = draw.standard_normal((6, size))
    x = centers[draw.integers(0, 6, 700)] + spread * draw.standard_normal((700, size))
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)] + [(1000 + i, [float(c) for c in x[3]]) for i in range(120)]
    odd = [(2000, None), (2050, [float("nan")] * size), (2100, [None] * size), (None, [1.0] * size), (50, rows[50][1])]
    table = spark.createDataFrame([*rows, *odd], "vec_id bigint, embedding array<double>")
    whole = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows}
    want = set()
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    importable(spark)
    assert {tuple(r) for r in top_k.top_k(table).collect()} == want
    assert top_k.top_k(table.limit(0)).count() == 0
    few = table.where("vec_id IN (0, 7)")
    assert [r.vec_id for r in top_k.top_k(few).collect()] == [7]


def test_dual_tree_is_exact():
    draw = np.random.default_rng(1)
    points = np.floor(256 * (draw.standard_normal((8, 5))[draw.integers(0, 8, 900)] + 0.02 * draw.standard_normal((900, 5))))
    found = top_k.Search(points[:90], np.full(90, -np.inf), points, 6).found
    best = {}
    for at, _, scores in found:
        for q, s in zip(at.tolist(), scores.tolist()):
            best.setdefault(q, []).append(s)
    for q in range(90):
        assert sorted(best[q])[-6:] == sorted(points @ points[q])[-6:]
