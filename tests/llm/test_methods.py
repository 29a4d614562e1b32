"""Operators against brute force, exact round trips and held-out accuracy."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from callgauge.llm import catalog, components, jaccard, packing, pages, pieces, quality, search, sharding, suffixes, toxicity  # noqa: F401
from callgauge.llm.registry import ORACLES, QUERIES
from callgauge.llm.stages import Stage

SMALL = "/root/testdata/sf0.001"


def texts(spark, n=None):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    return [(r.doc_id, r.text) for r in rows][:n]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)


# ---- 1 ----


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(1)
    calm = ["the", "river", "house", "green", "walk", "summer", "paper", "window"]
    rows, labels = [], []
    for i in range(600):
        words = rng.choices(calm, k=rng.randint(5, 120))
        toxic = i % 4 == 0
        for _ in range(2 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["glorkish", "vrimpy", "snazzled"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    docs = frame(spark, rows)
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, marks.filter(~toxicity.held_out()))).join(marks, "doc_id").filter(toxicity.held_out()).collect()
    assert len(scored) > 80 and np.mean([(r.score >= 0.5) == bool(r.toxic) for r in scored]) > 0.97


def test_passages_cover_the_text():
    text = "".join(map(chr, range(1000, 6000)))
    parts = toxicity.passages(text, 700)
    assert all(len(p) <= 700 for p in parts) and set("".join(parts)) == set(text)


# ---- 2 ----


def test_repeated_words(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices("abc", k=rng.randint(0, 40)))) for i in range(60)]
    for r in quality.text_counts(frame(spark, rows)).collect():
        w = dict(rows)[r.doc_id].split()
        windows = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        assert r.n_repeat_words == len({k for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for k in range(i, i + 5)})


def test_one_bad_vote_alone_rejects_nothing(spark):
    good = (0.9, {r: (0.95, 0.3) for r in quality.RULES})
    votes = spark.range(1).selectExpr("-1 AS vote_enough_words", *[f"1 AS vote_{r}" for r in list(quality.RULES)[1:]])
    assert votes.select(quality.posterior(*good).alias("p")).first().p > 0.5


# ---- 3 ----


def best_sum(p, text):
    best = [0.0] + [-np.inf] * len(text)
    for i in range(len(text)):
        single = False
        for j in range(i + 1, min(len(text), i + p.longest) + 1):
            if text[i:j] in p.match:
                single |= j == i + 1
                best[j] = max(best[j], best[i] + p.match[text[i:j]][1])
        if not single:
            best[i + 1] = max(best[i + 1], best[i] + p.unknown_score)
    return best[-1]


def test_viterbi_is_optimal_and_streams(spark):
    p = pieces.vocabulary(pieces.model_path())
    rng = random.Random(3)
    samples = ["".join(rng.choices("theraons ▁漢é", k=rng.randint(1, 400))) for _ in range(60)] + [t[:500] for _, t in texts(spark, 20) if t]
    scores = {i: s for i, s in p.match.values()}
    for text in samples:
        flat = p.normalize(text)
        parts = list(p.stream(flat))
        ids = [i for part in parts for i in part]
        unknown = sum(1 for c in re.findall(".", flat, re.S) if c not in p.match)
        total = sum(scores.get(i, 0.0) for i in ids) + unknown * p.unknown_score
        assert total == pytest.approx(best_sum(p, flat))
        assert p.encode(text).tolist() == [i for part in (p.parts.findall(flat)) for i in np.frombuffer(p.encode_part(part), "<u4")]
        assert p.decode(ids) == text.replace("▁", " ")
    long = p.normalize("ab" * 5000)
    given = list(p.stream(long))
    assert len(given) > 100 and p.decode([i for g in given for i in g]) == "ab" * 5000


# ---- 4 ----


def test_extraction_of_parts():
    tree = pages.trained_tree()
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><p>Site</p></header><nav><a href='/'>Home</a></nav><div class="notice">Closed today</div>
    <article><h1>Head &amp; line</h1><p>One <b>two</b>\n three<br>four &lt;p&gt;</p><script>var t="</p>";</script><div class='ad'>Buy this thing now</div><p>Last</p>
    <section id="comments"><p>I do not agree with any of this</p></section><form><label>Mail</label></form></article><aside><p>Aside</p></aside><footer>End</footer></body></html>"""
    assert pages.main_text(page, tree) == "Head & line\n\nOne two three four <p>\n\nLast"


# ---- 5 ----


def test_parts_encode_like_whole_texts(spark):
    t = packing.word_tokenizer(packing.tokenizer_path())
    odd = ["It's 3rd-rate, isn't it? 'tis", "ÀÉß Straße naïve", "漢字 kana かな 🙂", "a\tb c d\x1c e", "<|endoftext|> x", "İstanbul ΣΑΣ ﬁ é", "x" * 300]
    for text in odd + [x for _, x in texts(spark) if x]:
        assert t.encode(text).tolist() == t.tokenizer.encode(text, add_special_tokens=False).ids, text[:50]


def test_first_fit_takes_the_first_bin():
    rng = random.Random(5)
    lengths = np.array(sorted((rng.randint(1, 100) for _ in range(300)), reverse=True))
    rooms, want = [], []
    for n in lengths.tolist():
        k = next((k for k, r in enumerate(rooms) if r >= n), len(rooms))
        if k == len(rooms):
            rooms.append(100)
        want.append((k, 100 - rooms[k]))
        rooms[k] -= n
    bins, offsets = packing.first_fit(lengths, 100)
    assert list(zip(bins.tolist(), offsets.tolist())) == want


def test_packing_holds_every_id_once(spark):
    rows = texts(spark)
    pieces_ = packing.cut_pieces(frame(spark, rows), keep_ids=True)
    packed = packing.pack(pieces_, group_pieces=50).collect()
    t = packing.word_tokenizer(packing.tokenizer_path())
    whole = {i: [*t.encode(x).tolist(), 1] for i, x in rows}
    seen, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in packed:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(whole[r.doc_id])
        seen[r.doc_id].append((r.start, r.ids))
        bins[r.sequence_id].append((r.offset, r.length))
    assert {i: [x for _, ids in sorted(p) for x in ids] for i, p in seen.items()} == whole
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    back = {r.doc_id: r.ids for r in packing.unpack(packing.pack(pieces_, group_pieces=50)).collect()}
    assert back == whole


# ---- 6 ----


@pytest.mark.parametrize("group", [1000, 2])
def test_repeats_against_all_strings(spark, monkeypatch, group):
    monkeypatch.setattr(suffixes, "GROUP_STRETCHES", group)
    rng = random.Random(6)
    shared = ["".join(rng.choices("abcdé ", k=n)) for n in (35, 60, 200)]
    rows = [(i, "".join(rng.choice([rng.choice(shared), rng.choice(shared)[7:50], "".join(rng.choices("xyz", k=9))]) for _ in range(rng.randint(0, 9)))) for i in range(80)]
    rows += [(900, "q" * 90), (901, "".join(rng.choices("uvw", k=300)))]
    length = 40
    data = {i: t.encode() for i, t in rows}
    counts = collections.Counter(b[s:s + length] for b in data.values() for s in range(len(b) - length + 1))
    got = suffixes.remove_repeats(frame(spark, rows), length=length, span=20).collect()
    for r in got:
        b = data[r.doc_id]
        gone = {k for s in range(len(b) - length + 1) if counts[b[s:s + length]] > 1 for k in range(s, s + length)}
        left = bytes(x for k, x in enumerate(b) if k not in gone)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(left).hexdigest())


def test_levels_double(spark):
    family = suffixes.SuffixFamily(Stage(spark))
    rows = texts(spark, 40)
    for k in range(6):
        family.add(suffixes.entries(suffixes.texts_of(frame(spark, rows[k::6]))))
    assert [rank for rank, _ in family.levels] == [2, 1]


# ---- 7 ----


def test_shards_are_even_and_stable():
    names = [f"s{i}" for i in range(13)]
    full = sharding.fill_table(names, 1009)
    sizes = collections.Counter(full)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.fill_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(full, fewer) if a != 12)
    assert moved < 0.2 * 1009
    # turn by turn, by the definition
    owner, orders = [-1] * 1009, []
    for n in names:
        offset, step = sharding.preference(n, 1009)
        orders.append([(offset + k * step) % 1009 for k in range(1009)])
    while -1 in owner:
        for s, order in enumerate(orders):
            free = next((x for x in order if owner[x] < 0), None)
            if free is not None:
                owner[free] = s
    assert owner == full


# ---- 9 ----


def test_search_against_all_scores():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 8)) * 300
    r = np.floor(centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8)) * 5)
    r[100:160] = r[100]
    ids = rng.permutation(900)
    q, q_ids = r[:70], ids[:70]
    best, best_ids, formed = search.dual_search(q_ids, q, np.full(70, -np.inf), ids, r, 5, leaf=8)
    assert formed < 70 * 900
    for i in range(70):
        want = sorted((-int(s), int(x)) for s, x in zip(r @ q[i], ids) if x != q_ids[i])[:5]
        assert [(-int(s), int(x)) for s, x in zip(best[i], best_ids[i])] == want


def test_large_numbers_stay_exact(spark):
    big = 1.0e6
    rows = [(0, [big, big + 1 / 256]), (1, [big, big]), (2, [big, big - 1 / 256]), (3, [-big, 1.0])]
    data = search.usable(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    whole = {i: [int(np.floor(x * 256)) for x in v] for i, v in rows}
    want = sorted((-sum(a * b for a, b in zip(whole[0], whole[i])), i) for i in (1, 2, 3))
    got = search.top_k(data, data.filter("vec_id = 0")).orderBy("rank").collect()
    assert [(-r.score, r.vec_id) for r in got] == want


# ---- 10 ----


def brute_components(rows):
    sets, parent = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and sets[i] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies():
    rng = random.Random(10)
    base = [f"w{i}" for i in range(90)]
    rows = [(i, " ".join(base)) for i in range(3)]
    for i in range(3, 70):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"n{rng.random()}"
        rows.append((i, " ".join(w[rng.randint(0, 9):])))
    rows += [(100 + i, " ".join([*rng.choices("abcdefgh", k=60), *base[:30]])) for i in range(30)]
    rows += [(200, "One Two"), (201, "one two"), (202, "two one"), (203, "A b c d e"), (204, "É b c d e f"), (205, "é b c d e f")]
    return rows


@pytest.mark.parametrize("region,block", [(jaccard.REGION_SHINGLES, jaccard.BLOCK_SHINGLES), (300, 200)])
def test_components_against_all_pairs(spark, monkeypatch, region, block):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block)
    rows = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, rows), region).collect()}
    assert got == brute_components(rows)


def test_hot_shingles_go_the_other_way(spark):
    rows = spark.createDataFrame([(h, o, h % 2 == 0) for h in range(20) for o in range(h % 5 + 1) for _ in range(2)], "h bigint, owner bigint, hot boolean")
    got = {(r.pivot, r.owner) for r in jaccard.pivots_of_shared(rows).collect()}
    assert got == {(0, o) for o in range(5)}


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400)], "a bigint, b bigint")
    got = {r.node: r.component for r in components.components(links, Stage(spark)).collect()}
    assert all(got.get(i, 0) == 0 for i in range(201)) and got[500] == 400


# ---- all ----


def test_pipeline_stage_by_stage(spark):
    docs, small = spark.read.parquet(f"{SMALL}/documents.parquet"), None
    stage = Stage(spark)
    kept = {}
    for name, work in corpus_pipeline.STAGES:
        before = docs
        docs = stage.write(work(spark, before, SMALL), "test-stage")
        kept[name] = docs.count()
        if name == "n-gram Jaccard join":
            rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
            assert {r.doc_id for r in docs.collect()} == {c for _, c in brute_components(rows).values()}
        if name == "packing":
            small = docs
        else:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() <= before.count()
    again = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, small.select(again.columns).collect()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_ten_queries():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)
