"""SimHash groups, near duplicates, suffix repeats, benchmark leaks and lines."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import xxhash
from tests.llm.conftest import prose, words

from vecrec.llm import decontaminate, line_dedup, simhash, suffix_dedup
from vecrec.llm.components import components
from vecrec.session import cut_lineage, fewer_files


def reach_all(near):
    """Smallest position reachable, by brute force."""
    label = np.arange(len(near))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def plain_fingerprint(text, n):
    found = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(found[i : i + n]), 42) for i in range(max(1, len(found) - n + 1))] if found else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups_equal_brute_force(odd_docs, no_docs):
    got = simhash.simhash_groups(odd_docs, reach=14).collect()  # a wide reach, so that different texts link
    assert len(got) == odd_docs.count()
    texts = defaultdict(set)
    for r in odd_docs.collect():
        texts[r.doc_id].add(plain_fingerprint(r.text, 3))
    assert all(np.int64(r.fp).astype(np.uint64) in texts[r.doc_id] for r in got)
    fps = np.array([r.fp for r in got]).view(np.uint64)
    root = reach_all(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 14)
    for label in set(root):
        keys = [got[i].doc_id for i in np.flatnonzero(root == label)]
        assert {got[i].component for i in np.flatnonzero(root == label)} == {min((k for k in keys if k is not None), default=None)}
    assert simhash.simhash_groups(no_docs).count() == 0


def test_tree_finds_all_links(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    near = base[:1500] ^ (np.uint64(1) << rng.integers(0, 64, 1500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 1500, dtype=np.uint64))
    x = np.unique(np.concatenate([base, near]))
    links = simhash.linked_fingerprints(spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp bigint"), 2, leaf_rows=300).collect()
    at = {int(v): k for k, v in enumerate(x.view(np.int64))}
    own = np.eye(len(x), dtype=bool)
    for r in links:
        own[at[r.a], at[r.b]] = own[at[r.b], at[r.a]] = True
    assert (reach_all(own) == reach_all(np.bitwise_count(x[:, None] ^ x[None, :]) <= 2)).all()


def test_leaves_grow_with_the_fingerprints(spark, monkeypatch):
    """A sample smaller than the wanted leaves need does not bound their number, and all links are found at 2 bits."""
    rng = np.random.default_rng(12)
    fps = np.unique(np.concatenate([base := rng.integers(-(1 << 62), 1 << 62, 1500), base[:300] ^ (1 << rng.integers(0, 60, 300)), base[:200] ^ 5]))
    frame = spark.createDataFrame([(int(x),) for x in fps], "fp bigint").repartition(3)
    built = []
    original = simhash.build_tree
    monkeypatch.setattr(simhash, "build_tree", lambda sample, leaves: (built.append((len(sample), leaves)), original(sample, leaves))[1])
    links = {tuple(sorted(r)) for r in simhash.linked_fingerprints(frame, 2, sample_rows=10, leaf_rows=20).collect()}
    assert built[0][0] > 800 and built[0][1] >= 50
    x = fps.view(np.uint64)
    root = reach_all(np.bitwise_count(x[:, None] ^ x[None, :]) <= 2)
    place = {int(f): k for k, f in enumerate(fps)}
    near = np.eye(len(fps), dtype=bool)
    for a, b in links:  # spanning links: ends of one component, not always near each other
        near[place[a], place[b]] = near[place[b], place[a]] = True
    assert (reach_all(near) == root).all()


def test_components_of_chains_and_hubs(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(7, 7), (None, 3), (500, 499), (499, 500)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}, 499: 499, 500: 499}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def edited(text, share, seed):
    rng, found = random.Random(seed), text.split()
    for _ in range(int(share * len(found))):
        found[rng.randrange(len(found))] = rng.choice(words(9, 50))
    return " ".join(found)


def test_rounds_on_few_links_write_few_files(spark):
    put = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in put}
    try:
        for k, v in put.items():
            spark.conf.set(k, v)
        links = cut_lineage(spark.range(2000).selectExpr("id as a", "id - id % 4 as b"))
        found = components(links, "a", "b")
        assert len(found.inputFiles()) <= spark.sparkContext.defaultParallelism
        assert {(r.node, r.root) for r in found.collect()} == {(k, k - k % 4) for k in range(2000)}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert fewer_files(spark.range(0, 1000, 1, 64), 60_000_000).rdd.getNumPartitions() == 64


def test_near_duplicates_leave_one_of_each_group(spark, odd_docs, no_docs):
    rows = []
    for k in range(40):
        text = " ".join(words(1000 + k, 150 + 5 * k))
        rows += [(10 * k, text), (10 * k + 1, text), (10 * k + 2, edited(text, 0.01, k)), (10 * k + 3, edited(text, 0.5, k)), (10 * k + 4, " ".join(words(5000 + k, 200)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for hot in (20_000, 2):
        kept = {r.doc_id for r in simhash.drop_near_duplicates(docs, hot_rows=hot).collect()}
        assert {k for k in kept if k % 10 in (0, 3, 4)} == {10 * k + j for k in range(40) for j in (0, 3, 4)}
        assert len([k for k in kept if k % 10 in (1, 2)]) <= 1  # the sketch has an error of 0.03
    got = simhash.drop_near_duplicates(odd_docs)
    assert got.columns == odd_docs.columns
    kept = [r.doc_id for r in got.collect()]
    assert kept.count(20) == 0 and kept.count(3) == 1 and kept.count(None) == 1
    assert sum(k in kept for k in (22, 23, 24, 28)) == 1  # no words: copies of each other
    assert simhash.drop_near_duplicates(no_docs).count() == 0


def shingle_set(text):
    found = text.lower().split()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))}


def test_near_duplicates_are_judged_by_exact_similarity(spark):
    """Pairs just above and below 0.8, and a line repeated unequally often, against brute force."""
    rows, want = [], set()
    for k in range(160):
        found = words(7000 + k, 300)
        one = [*found]
        for p in range(5, 5 + 10 * (6 + k % 3 - (k % 2)), 10):  # every changed word breaks 5 shingles of 296
            one[p] = "zzz"
        a, b = " ".join(found), " ".join(one)
        if k >= 150:
            line = " ".join(words(9000 + k, 12))
            a, b = f"{a} {' '.join([line] * 2)}", f"{a} {' '.join([line] * 20)}"
        rows += [(2 * k, a), (2 * k + 1, b)]
        s, t = shingle_set(a), shingle_set(b)
        want |= {2 * k} if len(s & t) / len(s | t) >= 0.8 else {2 * k, 2 * k + 1}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert 160 < len(want) < 300
    for hot in (20_000, 1):
        assert {r.doc_id for r in simhash.drop_near_duplicates(docs, hot_rows=hot).collect()} == want


def test_near_duplicates_are_proposed_by_fingerprints(spark, monkeypatch):
    """Without the minimum hashes, what SimHash links is still found; the similarity decides about it."""
    rows, want, similar = [(1000, " ".join(words(40_000, 100)))], {1000}, 0
    for k in range(40):
        a = " ".join(words(30_000 + k, 400))
        b = edited(a, 0.004, k)
        line = " ".join(words(31_000 + k, 13)) + " "
        for j, pair in ((0, (a, b)), (2, tuple(line * 40 + " ".join(words(32_000 + 2 * k + i, 20)) for i in (0, 1)))):
            s, t = map(shingle_set, pair)
            if a == b or (plain_fingerprint(pair[0], 3) ^ plain_fingerprint(pair[1], 3)).bit_count() > 2:
                continue
            rows += [(4 * k + j, pair[0]), (4 * k + j + 1, pair[1])]
            near = len(s & t) / len(s | t) >= 0.8
            want |= {4 * k + j} if near else {4 * k + j, 4 * k + j + 1}
            similar += near
    assert similar >= 5 and len(want) > similar + 20
    monkeypatch.setattr(simhash, "proposed_links", lambda classes, *_: classes.selectExpr("ident AS a", "ident AS b").limit(0))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == want


def brute_repeats(texts):
    count, data = defaultdict(int), [(t or "").encode() for t in texts]
    for d in data:
        for s in range(len(d) - 399):
            count[d[s : s + 400]] += 1
    for d in data:
        gone = np.zeros(len(d) + 1, int)
        for s in range(len(d) - 399):
            if count[d[s : s + 400]] > 1:
                gone[s] += 1
                gone[s + 400] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        kept = bytes(b for b, g in zip(d, gone) if not g)
        yield len(d), int(gone.sum()), len(suffix_dedup.runs_of(gone)), hashlib.sha256(kept).hexdigest()


def test_suffix_dedup_equals_brute_force(spark, odd_docs, no_docs):
    shared, other = prose(77, 90), prose(78, 60)
    more = [(100, prose(201, 50) + shared + prose(202, 70)), (101, prose(203, 10) + shared[20:] + prose(204, 70)), (102, prose(205, 90) + shared + other), (103, other[:399]), (104, other[:400]), (105, "a" * 1700), (106, "ab" * 500 + "a" * 420), (107, shared[:500] + "ü" + shared[500:]), (108, prose(206, 30) + shared * 2)]
    docs = odd_docs.select("doc_id", "text", "row", "found").unionByName(spark.createDataFrame([(k, t, "r", "f") for k, t in more], "doc_id bigint, text string, row string, found string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(((k, *x) for (k, _), x in zip(rows, brute_repeats([t for _, t in rows]), strict=True)), key=repr)
    for hot in (suffix_dedup.HOT_SEGMENTS, 1):
        assert sorted((tuple(r) for r in suffix_dedup.remove_repeats(docs, hot_segments=hot).collect()), key=repr) == want
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_leaks_are_found_under_edits(spark, odd_docs, no_docs):
    items = [(k, " ".join(words(300 + k, 12 + k))) for k in range(60)]
    texts, rng = [], random.Random(4)
    for k, (_, item) in enumerate(items):
        found = item.split()
        for _ in range(int(0.2 * len(found))):
            p, how = rng.randrange(len(found)), rng.random()
            found[p : p + 1] = [] if how < 0.3 else ["zzz"] if how < 0.6 else [found[p], "yyy"]
        texts.append((k, f"{prose(400 + k, 80)}\n{', '.join(found).upper()}! {prose(500 + k, 30)}"))
    texts += [(1000 + k, prose(600 + k, 200)) for k in range(30)]
    docs, bench = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame([*items, (None, "x " * 20), (90, None), (91, "too short")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    # exact distance by brute force; all that is found holds it, nearly all that holds it is found
    for k, item in got:
        assert k == item
    assert len(got) >= 57
    blocks = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, block_chars=2_000).collect()}
    assert len(blocks & got) >= 56
    clean = decontaminate.decontaminate(docs, bench)
    assert {r.doc_id for r in clean.collect()} == {k for k, _ in texts} - {k for k, _ in got}
    assert decontaminate.decontaminate(odd_docs, bench).columns == odd_docs.columns
    assert decontaminate.decontaminate(odd_docs, bench).count() == odd_docs.count()
    assert decontaminate.contaminated(no_docs, bench).count() == 0 == decontaminate.contaminated(docs, bench.limit(0)).count()


def test_windows_of_a_crowded_lead_are_counted(spark):
    """Segments of one lead need no common task: windows of equal bytes are tied, in any segment and place."""
    shared = prose(801, 100).encode()[:450]
    parts = [prose(802 + k, 30).encode()[: 60 + k] + shared + prose(902 + k, 30).encode()[:70] for k in range(30)]
    rows = [("lead", f"d{k}".encode(), k == 3, 5, 5 + len(p) - 400, p) for k, p in enumerate(parts)]
    crowd = spark.createDataFrame([(r[0].encode(), *r[1:]) for r in [*rows, rows[0]]], "lead binary, digest binary, often boolean, low int, high int, part binary").repartition(7)
    got = {bytes(r.digest): np.frombuffer(r.runs, "<i4").reshape(-1, 2).tolist() for r in suffix_dedup.counted(crowd).collect()}
    count = defaultdict(int)
    for p in parts:
        for s in range(len(p) - 399):
            count[p[s : s + 400]] += 1
    ties = {k: [s + 5 for s in range(len(p) - 399) if count[p[s : s + 400]] > 1] for k, p in enumerate(parts)}
    assert all(len(x) >= 51 for x in ties.values())
    assert got == {f"d{k}".encode(): [[x[0], x[-1]]] for k, x in ties.items() if k != 3}


def found_in(items, texts):
    block = decontaminate.Items.of(items)
    return {(t, block.ids[i], e) for t, i, e in decontaminate.search(block, [decontaminate.tokens(x) for x in texts])}


def test_shortest_searched_items_are_found():
    for low in (8, 9, 10):
        items = [(k, " ".join(words(2000 + k, low + k % 3))) for k in range(45)]
        whole = [f"{prose(2100 + k, 40)} {item} {prose(2200 + k, 40)}" for k, item in items]
        assert found_in(items, whole) >= {(k, k, 0) for k, _ in items}
        one_off = [x.replace(item, " ".join([*item.split()[:3], "zzz", *item.split()[4:]])) for x, (_, item) in zip(whole, items, strict=True)]
        assert len(found_in(items, one_off) & {(k, k, 1) for k, _ in items}) >= 43


def test_long_items_are_found_under_edits():
    for n in (100, 200, 400):
        rng, items, texts = random.Random(n), [(k, " ".join(words(3000 + k, n))) for k in range(40)], []
        for k, item in items:
            found = item.split()
            for _ in range(n // 5):
                p, how = rng.randrange(len(found)), rng.random()
                found[p : p + 1] = [] if how < 0.3 else ["zzz"] if how < 0.6 else [found[p], "yyy"]
            texts.append(f"{prose(3100 + k, 60)} {' '.join(found)} {prose(3200 + k, 60)}")
        assert len({(t, k) for t, k, _ in found_in(items, texts)} & {(k, k) for k, _ in items}) >= 39, n


def test_short_items_and_scripts_without_spaces_are_found():
    items = [(1, "Forty-two!"), (2, "one two three four five six seven"), (3, "北京是中国的首都，也是全国的政治中心"), (4, "ประเทศไทย"), (5, "東京"), (6, "Paris"), (7, " ?! ")]
    texts = ["It is FORTY two.", "one two three four five six", "Zero one, two three four five six seven", "他说北京是中国的首都，亦是全国的政治中心。", "อยู่ในประเทศไทยวันนี้", "昨日東京で", "forty and two", "", "paris", None]
    assert found_in(items, texts) == {(0, 1, 0), (1, 2, 1), (2, 2, 0), (3, 3, 1), (4, 4, 0), (5, 5, 0), (8, 6, 0)}
    assert found_in(items[:2], texts) == {(0, 1, 0), (1, 2, 1), (2, 2, 0)}
    long = " ".join(words(4000, 30))
    assert found_in([*items, (8, long)], [f"x {long} Paris"]) == {(0, 8, 0), (0, 6, 0)}


def test_items_of_every_short_length_equal_brute_force():
    """All pairs of texts and items by the least edits of any window: 5 to 7 words allow one edit like 8 do."""
    rng = np.random.default_rng(9)
    draw = lambda n: " ".join(rng.choice(list("abcdef"), n))
    items = [(k, draw(1 + k % 7)) for k in range(70)] + [(70, "a a a a a"), (71, "b b b b b b"), (72, "a a a a a")]
    texts = [draw(int(rng.integers(0, 30))) for _ in range(150)] + ["a a zz a a", "zz a a a a zz", "b b b b b", "a a a", "a a", "", "a a zz zz a a a", "x"]
    want = set()
    for t, text in enumerate(texts):
        for key, item in items:
            codes = {w: i for i, w in enumerate(sorted(set(item.split() + text.split())))}
            at = lambda s, codes=codes: np.array([codes[w] for w in s.split()], np.int64)
            edits = decontaminate.least_edits(at(item), at(text))[0]
            if edits <= len(item.split()) // 5:
                want.add((t, key, edits))
    assert found_in(items, texts) == want and {e for *_, e in want} == {0, 1}
    block = decontaminate.Items.of(items, least_words=5)
    assert min(len(w) for w in block.words) == 5 and len(block.ids) == sum(len(i.split()) >= 5 for _, i in items)


def test_least_edits_equals_brute_force():
    def plain(item, text):
        row = [0] * (len(text) + 1)
        for k, w in enumerate(item, 1):
            new = [k]
            for j, t in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != t)))
            row = new
        return min(row)

    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        assert decontaminate.least_edits(np.array(a), np.array(b))[0] == plain(a, b)


def test_boilerplate_lines_by_site(spark):
    page = lambda *x: "".join(f"<p>{t}</p>" for t in x)
    rows = [(k, f"http://one.org/{k}", page("Menu", f"own {k}", "Menu", "rare" if k < 2 else f"z{k}")) for k in range(10)]
    rows += [(20 + k, f"https://u@Two.org:80/{k}", page("Menu", f"own {k}")) for k in range(2)]
    rows += [(30, None, page("Menu")), (31, "no url", None), (32, "http://one.org/x", ""), (33, "http://one.org/0", page("Menu", "own 0")), (None, "http://one.org", "<script>Menu</script><b>Men</b>u")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, host string, dropped string")
    got = {r.page_id: r for r in line_dedup.drop_boilerplate(pages).collect()}
    assert len(got) == len(rows)
    assert (got[5].n_lines, got[5].n_dropped, got[5].kept_text, got[5].host) == (4, 2, "own 5\nz5", "one.org")
    assert got[0].kept_text == "own 0\nrare" and got[20].kept_text == "Menu\nown 0" and got[20].host == "two.org"
    assert got[30].n_dropped == 0 and got[31].n_lines == 0 == got[32].n_lines and got[None].kept_text == ""
    assert line_dedup.drop_boilerplate(pages.limit(0)).count() == 0


def test_planted_passages_go_exactly_where_400_bytes_repeat(spark):
    """Passages of 52 to 200 words in many documents, some under 400 bytes: only repeated strings of 400 bytes count."""
    passages = [prose(700 + k, n) for k, n in enumerate((52, 60, 70, 80, 100, 120, 160, 200))]
    rows = [(100 * k + m, f"{prose(3000 + 100 * k + m, 20 + 9 * (m % 7))} {p} {prose(9000 + 100 * k + m, 15 + 8 * (m % 5))}") for k, p in enumerate(passages) for m in range(12 if k % 2 else 5)]
    rows += [(5000 + k, prose(20_000 + k, 90)) for k in range(25)]
    want = sorted((k, *x) for (k, _), x in zip(rows, brute_repeats([t for _, t in rows]), strict=True))
    sizes = [len(p.encode()) for p in passages]
    assert min(sizes) < 380 and max(sizes) > 900
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for hot in (suffix_dedup.HOT_SEGMENTS, 4):
        got = sorted(tuple(r) for r in suffix_dedup.remove_repeats(docs, hot_segments=hot).collect())
        assert got == want
    for key, _, removed, _, _ in want:
        # a space on either side repeats with its passage
        assert (removed > 0) == (key < 5000 and sizes[key // 100] + 2 >= suffix_dedup.SPAN)
