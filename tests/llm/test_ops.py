import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textloom.llm import ann, bpe, chat, components, html_extract, licenses, line_dedup, mixing, near_copies, quality, sharding, simhash

SCHEMA = "doc_id long, text string, source string, n_words string, ids string, rank string, fp string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def make(spark, rows):
    """Documents with extra columns that carry names the operators use."""
    return spark.createDataFrame([(i, t, s, "x", "y", "z", "w") for i, t, s in rows], SCHEMA)


def corpus(n=120, seed=3):
    rnd = random.Random(seed)
    rows = [(k, "\n".join(" ".join(rnd.choices(WORDS, k=rnd.randint(1, 30))) for _ in range(rnd.randint(1, 6))), f"s{k % 3}") for k in range(n)]
    rows += [(n, None, None), (n + 1, "", "s0"), (n + 2, " \t\n ", "s1"), (None, "no id here at all", "s1"), (n + 3, "a" * 50_000, "s0"), (n + 4, rows[0][1], "s0"), (n + 4, rows[0][1], "s0")]
    return rows + [(n + 10 + k, rows[1][1] + "\nCommon Line ", "s2") for k in range(15)]


# --- sharding


def all_cuts(sizes, shards):
    n = len(sizes)
    return min(max(sum(sizes[a:b]) for a, b in itertools.pairwise((0, *cut, n))) for cut in itertools.combinations_with_replacement(range(n + 1), shards - 1))


def test_capacity_is_the_least():
    rnd = random.Random(1)
    for _ in range(60):
        sizes = [rnd.randint(1, 30) for _ in range(rnd.randint(1, 9))]
        shards = rnd.randint(1, 4)
        best = all_cuts(sizes, shards)
        assert sharding.minimax_capacity(sizes, shards) == best
        cuts = sharding.balanced_cuts(sizes, shards, best)
        assert max(sum(sizes[a:b]) for a, b in itertools.pairwise((0, *cuts))) <= best and cuts[-1] == len(sizes)
        assert sharding._lower_bound(sizes, [True] * len(sizes), shards, best) <= best


def test_shards(spark):
    rows = corpus()
    found = sharding.shard(make(spark, rows), 4).collect()
    assert len(found) == len(rows)
    sizes = Counter()
    for r in found:
        sizes[r.shard] += r.size
    for k in range(4):
        assert sorted(r.slot for r in found if r.shard == k) == list(range(sum(r.shard == k for r in found)))
    texts = {i: t or "" for i, t, _ in rows}
    place = {}
    for r in found:
        assert r.size == len(texts[r.id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.id].encode())
        assert place.setdefault(texts[r.id], r.shard) == r.shard
    groups = {}
    for r in found:
        key = xxhash.xxh64_intdigest(texts[r.id].encode(), 42)
        groups[key] = groups.get(key, 0) + r.size
    assert max(sizes.values()) == sharding.minimax_capacity([groups[k] for k in sorted(groups)], 4)


# --- byte-pair encoding


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.default_path()
    own = tokenizers.Tokenizer.from_file(path)
    rnd = random.Random(5)
    letters = [*"ab'stre  \n\t\r0189é中。!-_<>😀", "<|endoftext|>", "'ll", "  ", "\u0085", "　"]
    texts = ["".join(rnd.choices(letters, k=rnd.randint(0, 40))) for _ in range(400)] + ["", None, "x" * 5000, "ab" * 400 + " c"]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    back = {r.doc_id: r for r in bpe.decode(bpe.encode(df, path), path).collect()}
    for k, text in enumerate(texts):
        ids = own.encode(text or "", add_special_tokens=False).ids
        assert list(back[k].ids) == ids and back[k].decoded == own.decode(ids, skip_special_tokens=False)


def test_segment_tree_merges_like_the_scan():
    codec = bpe.ByteBPE(open(bpe.default_path(), "rb").read())
    for word in (b"hello", b"aaaaaaa", b"internationalization" * 5, b"x"):
        ids = [codec.byte_id[b] for b in word]
        while True:
            ranks = [(codec.merges[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in codec.merges]
            if not ranks:
                break
            _, k = min(ranks)
            ids[k : k + 2] = [codec.merges[ids[k], ids[k + 1]][1]]
        assert codec.merge(word) == ids == np.frombuffer(codec.merge_many([word])[0], "<i4").tolist()


# --- near-duplicates


def plain_fingerprint(text, words):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark):
    rows = corpus()
    found = simhash.near_duplicates(make(spark, rows)).collect()
    fps = [plain_fingerprint(t, 3) for _, t, _ in rows]
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            x, y = group[a], group[b]
            group = [x if g == y else g for g in group]
    want = Counter((rows[k][0], fps[k], min((rows[j][0] for j in range(len(rows)) if group[j] == group[k] and rows[j][0] is not None), default=None)) for k in range(len(rows)))
    assert Counter((r.id, r.fp % (1 << 64), r.component_id) for r in found) == want


@pytest.mark.parametrize(("distance", "segments"), [(3, 2), (3, 4), (5, 2), (0, 1)])
def test_links_lose_nothing(spark, distance, segments):
    rnd = random.Random(distance)
    base = [rnd.getrandbits(64) for _ in range(20)]
    fps = {b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 6))) for b in base for _ in range(6)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = {(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), distance, segments).collect()}
    want = {frozenset(p) for p in itertools.combinations(fps, 2) if (p[0] ^ p[1]).bit_count() <= distance}
    assert {frozenset(p) for p in found} == want


def test_near_copies_equal_brute_force(spark):
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    texts = [rnd.choices(words, k=rnd.randint(40, 400)) for _ in range(60)]
    for base in texts[:40]:  # copies with a few words changed, near and beyond the bound
        for edits in (1, 2, 4, 8):
            texts.append([rnd.choice(words) if rnd.random() < edits / len(base) else w for w in base])
    hub = rnd.choices(words, k=300)
    texts += [[rnd.choice(words) if rnd.random() < 0.006 else w for w in hub] for _ in range(60)]
    rows = [(k, " ".join(t), "s") for k, t in enumerate(texts)]
    n = len(rows)
    rows += [(n, None, "s"), (n + 1, "", "s"), (n + 2, " \n", "s"), (n + 3, "three words here", "s"), (n + 4, "THREE  words here", None), (n + 5, rows[0][1], "s"), (n + 5, rows[0][1], "s"), (None, rows[0][1], "s")]
    found = near_copies.near_copies(make(spark, rows), carry=("source",)).collect()
    assert len(found) == len(rows) and {len(r) for r in found} == {4}
    component = {r.id: r.component_id for r in found if r.id is not None}
    assert component[n] == component[n + 1] == component[n + 2] == n and component[n + 4] == n + 3 and component[n + 5] == component[0]

    sets = [set(zip(*(t[k:] for k in range(5)))) for t in texts]
    similar, missed = 0, 0
    for a, b in itertools.combinations(range(n), 2):
        j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        if j >= 0.8:
            similar, missed = similar + 1, missed + (component[a] != component[b])
        if j < 0.01 and a < 60 and b < 60:
            assert component[a] != component[b]
    assert similar > 500 and missed <= 0.01 * similar


def test_near_copies_below_the_bound_stay_apart(spark):
    rnd = random.Random(6)
    rows = []
    for k in range(150):
        t = [f"w{rnd.randrange(5000)}" for _ in range(200)]
        spots = rnd.sample(range(3, 197, 6), 10)
        rows += [(2 * k, " ".join(t), "s"), (2 * k + 1, " ".join(f"x{i}" if i in spots else w for i, w in enumerate(t)), "s")]  # similarity about 0.6
    found = near_copies.near_copies(make(spark, rows)).where("component_id <> id").count()
    assert found <= 3
    assert near_copies.near_copies(make(spark, [])).count() == 0


def exact_groups(texts, least=0.8):
    """The smallest index of each text's group, by brute force over five-word shingles (whole texts where shorter)."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))})
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        shared = len(sets[a] & sets[b])
        if 5 * shared >= 5 * least * (len(sets[a]) + len(sets[b]) - shared) - 1e-9:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    return root


def test_near_copies_just_below_the_bound_stay_apart(spark):
    rnd = random.Random(16)
    texts = []
    for k in range(120):  # similarities from 0.70 to 0.77
        t = [f"w{rnd.randrange(5000)}" for _ in range(200)]
        spots = rnd.sample(range(4, 196, 6), 5 + k % 3)
        texts += [" ".join(t), " ".join(f"x{i}" if i in spots else w for i, w in enumerate(t))]
    assert exact_groups(texts) == list(range(240))
    found = near_copies.near_copies(make(spark, [(k, t, "s") for k, t in enumerate(texts)])).collect()
    assert [r for r in found if r.component_id != r.id] == []


def test_short_near_copies_are_all_found(spark):
    rnd = random.Random(17)
    texts = []
    for small, large in ((4, 5), (6, 7), (8, 10), (12, 15), (20, 25), (28, 35), (100, 125), (4, 6), (12, 16)):  # shingles
        for _ in range(12):
            t = [f"w{rnd.randrange(5000)}" for _ in range(large + 4)]
            texts += [" ".join(t[: small + 4]), " ".join(t)]
    want = exact_groups(texts)
    assert sum(r != k for k, r in enumerate(want)) == 7 * 12
    found = {r.id: r.component_id for r in near_copies.near_copies(make(spark, [(k, t, "s") for k, t in enumerate(texts)])).collect()}
    assert [found[k] for k in range(len(texts))] == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    found = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


# --- lines


@pytest.mark.parametrize("most", [500_000, 0])
@pytest.mark.parametrize("first", [False, True])
def test_line_dedup(spark, most, first):
    rows = [r for r in corpus() if r[0] is not None]
    rows = [r for k, r in enumerate(rows) if r not in rows[:k]]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    seen = {}
    for i, t, _ in rows:
        for n, line in enumerate((t or "").split("\n")):
            if key(line):
                seen.setdefault(key(line), {}).setdefault(i, n)
    hot = {k: min(v.items()) for k, v in seen.items() if len(v) >= 10}
    assert hot
    found = {r.doc_id: r for r in line_dedup.line_dedup(make(spark, rows), keep_first=first, broadcast_keys=most).collect()}
    for i, t, s in rows:
        lines = (t or "").split("\n")
        kept = [x for n, x in enumerate(lines) if key(x) not in hot or first and hot[key(x)] == (i, n)]
        assert found[i].text == "\n".join(kept) and found[i].n_lines == len(lines) and found[i].n_dropped == len(lines) - len(kept) and found[i].source == s and found[i].ids == "y"


def test_filters_merge_without_loss():
    bits, parts, keys = 12, [], [line_dedup._hash(b"%d" % k) for k in range(60)]
    for share in (keys[:30], keys[20:50], keys[45:]):
        once, twice = (np.zeros((1 << bits) // 8, np.uint8) for _ in range(2))
        line_dedup._put(once, line_dedup._positions(line_dedup._halves(share), bits))
        parts.append((once.tobytes(), twice.tobytes()))
    _, twice = line_dedup.merge_filters(iter(parts))
    held = line_dedup._holds(twice, line_dedup._positions(line_dedup._halves(keys), bits))
    assert held[20:30].all() and held[45:50].all() and held.sum() < 40


# --- nearest neighbours


def test_hilbert_visits_neighbours():
    grid = np.array(list(itertools.product(range(8), repeat=2)))
    walk = grid[np.argsort(ann.hilbert(grid, 3))]
    assert len(set(ann.hilbert(grid, 3).tolist())) == 64 and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1800, 8)).astype(np.float32)
    x[100:140] = x[100]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5000, None), (5100, [0.0] * 8), (5200, [float("nan")] + [1.0] * 7), (5300, [1.0]), (None, [1.0] * 8), (5400, [None] + [1.0] * 7), (7, x[7].tolist()), (5500, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    found = {}
    for r in ann.nearest_neighbours(df, F.col("id") % 100 == 0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(found) == list(range(0, 1800, 100))
    hits = 0
    for q, got in found.items():
        got.sort()
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        true = np.lexsort((np.arange(len(x)), d))[:10]
        hits += len(set(true) & {v for _, v, _ in got})
        assert [r for r, _, _ in got] == list(range(1, 11)) and all(abs(d[v] - s) < 1e-12 for _, v, s in got)
    assert hits >= 0.9 * 10 * len(found) and [v for _, v, _ in found[100]] == list(range(101, 111))
    assert ann.nearest_neighbours(df.limit(0), F.col("id") % 100 == 0).count() == 0
    few = ann.nearest_neighbours(df.where("vec_id in (0, 1, 2)"), F.col("id") == 0).collect()
    assert sorted(r["rank"] for r in few) == [1, 2]


# --- conversations


def test_chat(spark):
    a = [("user", "hi"), ("assistant", "yo"), ("user", "more")]
    logs = {1: a[:1], 2: a[:2], 3: a, 4: a, 5: [("user", "hi"), ("assistant", "other")], 6: [("user", None)], 7: a[1:]}
    rows = [(c, k, r, t) for c, turns in logs.items() for k, (r, t) in enumerate(turns)] + [(8, 10 * k, "user", f"t{k % 5}") for k in range(700)] + [(9, 10 * k, "user", f"t{k % 5}") for k in range(600)] + [(None, None, None, None)]
    found = {r.conv_id: r for r in chat.chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit("x"))).collect()}
    assert set(found) == {3, 5, 6, 7, 8, None} and found[3].n_logs == 2 and found[8].n_turns == 700
    assert found[5].text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nother<|im_end|>"
    assert chat.chat_format(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- mixing


def plain_targets(sizes, weights, most):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, left, free = {}, float(sum(sizes.values())), set(order)
    while True:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s] + 1e-9}
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over


def test_mixing(spark):
    rows = [(k, " ".join(["w"] * (3 + k % 7)), "abc"[0 if k < 12 else 1 if k < 300 else 2]) for k in range(400)] + [(400, "one two", None), (401, None, "a"), (402, "", "b"), (403, "w " * 9000, "c"), (5, "w w w w w w w w", "a"), (5, "w w w w w w w w", "a")]
    documents, plan, pieces = mixing.mix(make(spark, rows), (5.0, 2.0, 1.0))
    got = mixing.taken(documents, pieces).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets(sizes, (5.0, 2.0, 1.0), 3)
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    goal = {r.src: r.target for r in plan.collect()}
    for s, t in want.items():
        src = "b" if s is None else "a" + s
        assert goal[src] == pytest.approx(t) and abs(sum(r.taken for r in got if r.src == src) - t) <= 1
    again = mixing.taken(*mixing.mix(make(spark, rows[::-1]), (5.0, 2.0, 1.0))[::2]).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    empty = mixing.mix(make(spark, []), (1.0,))
    assert mixing.taken(empty[0], empty[2]).count() == 0


# --- quality


def plain_repeats(words):
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return len({i + j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(5)})


def test_quality(spark):
    clean = [(k, " ".join(WORDS[(k + j) % 20] + str(k) for j in range(20)) + "\nshared footer of the host 1", "h") for k in range(1000, 1030)]
    thin = [(k, "word number %s of a thin page is here\nshared footer of the host %d\nShared  FOOTER of the host 3" % (WORDS[k % 20], k), "h") for k in range(2000, 2020)]
    rows = corpus() + clean + thin + [(9, "a b c d e a b c d e x y z q r s t u v w #$ %", "s0")]
    got = {r.t: r for r in quality.quality_rules(make(spark, rows)).collect()}
    everything = quality.quality_rules(make(spark, rows)).count()
    assert everything == len(rows)
    found = {}
    for r in quality.quality_rules(make(spark, rows)).collect():
        found.setdefault(r.id, r)
    for i, t, _ in rows:
        words = (t or "").split()
        lines = [x for x in (t or "").split("\n") if x.split()]
        repeats = plain_repeats(words)
        r = found[i]
        if i == 9 and t != rows[9][1]:
            continue
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(words), sum(map(len, words)), repeats, len(lines) - len(set(lines)))
        assert r.base_failed == (len(words) < 10 or 100 * repeats > 20 * len(words))
    assert all(found[k].kept for k, _, _ in clean) and not any(found[k].kept for k, _, _ in thin) and got


def test_quality_removes_lines_above_the_limit(spark):
    import corpus_pipeline

    body = lambda k: "\n".join(" ".join(f"{w}x{k}{j}".translate(str.maketrans("0123456789", "abcdefghij")) for w in WORDS[:8]) for j in range(2))
    rows = [(k, f"Page {k}\n{body(k)}\n\n page  {k + 7}", "h") for k in range(30)]  # one line in all, but for its number
    rows += [(100 + k, f"Page {k}\n{body(100 + k)}", "i" if k else None) for k in range(9)]  # too few on their hosts
    rows += [(200 + k, f"Page {k}\nfew words", "h") for k in range(3)]  # rejected
    rows += [(5, rows[5][1], "h")]
    want = sorted([(k, body(k) + "\n", "h") for k in range(30)] + [(5, body(5) + "\n", "h")] + rows[30:39], key=str)
    got = quality.quality_texts(make(spark, rows))
    assert got.columns == make(spark, []).columns
    assert sorted([(r.doc_id, r.text, r.source) for r in got.collect()], key=str) == want
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, source string, n_chars long")
    found = corpus_pipeline.quality_stage(spark, docs, "").collect()
    assert sorted([(r.doc_id, r.text, r.source) for r in found], key=str) == want and all(r.n_chars == len(r.text) for r in found)


# --- licences


def test_licenses(spark):
    rows = [
        (1, "This work is licensed under the GNU General Public License, version 3.", "s"),
        (2, "Licensed under CC BY-NC 4.0. Released under the MIT License. MIT license", "s"),
        (3, "gnu general public apache. license apache license", "s"),
        (4, "Permission is hereby granted, free of charge, to any person", "s"),
        (5, None, "s"),
        (6, "plain words only", "s"),
        (7, "x " * 30_000 + "Mozilla Public License", "s"),
        (1, "This work is licensed under the GNU General Public License, version 3.", "s"),
    ]
    out = licenses.scan(make(spark, rows)).collect()
    assert len(out) == len(rows)
    got = {r.id: r for r in out}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].labels, got[1].score) == (12, 1, 6, "gpl,gpl-3.0", 1.0)
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels, got[2].labels) == (3, 2, 12, "cc-by,mit", "cc-by,cc-by-nc-4.0,mit")
    assert (got[3].n_base, got[3].labels) == (2, "apache") and got[4].labels == "mit-text" and got[7].labels == "mpl-2.0"
    assert (got[5].n_words, got[5].first_word, got[5].labels, got[5].score) == (0, None, "", 0.0) and got[6].n_base == 0


# --- pages

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var t="</p>";</script></head><body><nav><a>menu</a></nav><div class="ad">buy %d</div>
<article><h1>Head &amp; more %d</h1><p><b>first %d<br><p>second &lt;%d&gt;<aside>no</aside><div class="comments"><p>great!</p></div><div class="outro">Read on our site</div></article><footer>end</footer></body></html>"""


@pytest.mark.parametrize("most", [200_000, 0])
def test_pages(spark, most):
    rows = [(k, f"http://a.example/{k}", PAGE % (k, k, k, k), "t") for k in range(8)] + [(20, None, None, "t"), (21, "http://b.example/", "", "t"), (22, "x", "<p>one<p>two &nbsp; three", "t"), (22, "x", "<p>one<p>two &nbsp; three", "t")]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), broadcast_paths=most).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == len(rows) and got[20] == got[21] == "" and got[22] == "one\n\ntwo three"
    for k in range(8):
        assert got[k] == f"Head & more {k}\n\nfirst {k}\n\nsecond <{k}>"


def test_pages_alone_are_kept_whole():
    text = "<body><div id='main'>a<br>b<ul><li>c<li>d</ul><table><tr><td>e<td>f</table></div><form>q</form><!-- x --></body>"
    assert html_extract.blocks(text) == ["a b", "c", "d", "e", "f"]


# --- the whole


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", s, len(t or "")) for i, t, s in corpus(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, "")
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if k == 2:
            assert docs.groupBy("text").count().where("count > 1").count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert len(out) == docs.count() > 20 and all(r.round_trip and r.n_tokens == len(r.ids) for r in out)


def test_empty_tables(spark):
    docs = make(spark, [])
    assert sharding.shard(docs, 16).count() == simhash.near_duplicates(docs).count() == line_dedup.line_dedup(docs).count() == 0
    assert quality.quality_rules(docs).count() == licenses.scan(docs).count() == bpe.encode(docs, bpe.default_path()).count() == 0
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
