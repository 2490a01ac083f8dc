"""Each operator against a brute-force version on small documents, and its edge cases."""

import base64
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from hearthlake.llm import decontaminate, exact_dedup, kernels, mixing, ngram_join, quality, sharding, substring_dedup, url_filter, warc

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, h string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def corpus(seed=1, n=120):
    """Random texts, near copies of many degrees, exact copies, nulls, empty and long ones, repeated rows, null ids."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    texts = []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.45:
            w = (rng.choice(texts) or "").split(" ")
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
        elif kind < 0.5:
            texts.append(rng.choice(["", None, "  \t\n", "One", "one TWO  three"]))
        else:
            texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 9, 20, 60, 150, 900]))))
    rows = [(i * 3 % 1000, t, "en", rng.choice(["a", "b", None, "é"]), 0, "k", "x") for i, t in enumerate(texts)]
    return rows + [rows[0], rows[0], (None, "no id at all here", "en", "a", 0, None, None), (None, None, None, None, None, None, None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, percent):
    sets = {}
    for r in rows:
        if r[0] is not None:
            sets.setdefault(r[0], []).append(shingles(r[1], k))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x & y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                u, v = find(a), find(b)
                parent[max(u, v)] = min(u, v)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("k", "percent", "seed"), [(4, 85, 1), (5, 80, 2), (2, 60, 3)])
def test_jaccard_components_equal_brute_force(spark, k, percent, seed):
    rows = corpus(seed)
    want = brute_components(rows, k, percent)
    got = ngram_join.jaccard_components(frame(spark, rows), k, percent).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in got) == sorted(
        (r[0] is None, r[0] or 0, len(shingles(r[1], k)), want.get(r[0])) for r in rows
    ), "one row per row"


def test_jaccard_groups_are_opened(spark):
    """A chain whose links are not between first members: found only by opening groups."""
    base = [f"w{i}" for i in range(200)]
    rows = []
    for step in range(12):
        w = [f"x{step - i}-{i}" if i < step else base[i] for i in range(200)]
        w = [f"v{i}" if i < 6 * step else base[i] for i in range(200)]
        rows.append((step, " ".join(w), "en", "a", 0, "", ""))
    want = brute_components(rows, 4, 85)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(frame(spark, rows), 4, 85).collect()}
    assert got == want


def test_blocks_never_miss_a_pair():
    import numpy as np

    rng = np.random.default_rng(5)
    for percent in (60, 80, 85, 95):
        for n in (1, 2, 3, 5, 8, 13, 40, 77, 150, 600):
            for _ in range(6):
                common = rng.integers(0, 1 << 63, n).astype(np.uint64)
                budget = int(n * (100 - percent) / percent)
                x = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, rng.integers(0, budget + 1)).astype(np.uint64)]))
                y = np.unique(common)
                both = len(np.intersect1d(x, y))
                assert 100 * both >= percent * (len(x) + len(y) - both)
                _, sig_x, _ = ngram_join.blocks(x, np.array([0, len(x)]), percent)
                _, sig_y, _ = ngram_join.blocks(y, np.array([0, len(y)]), percent)
                assert set(sig_x.tolist()) & set(sig_y.tolist())


def test_empty_tables(spark):
    none = frame(spark, [])
    assert ngram_join.jaccard_components(none).count() == 0
    assert exact_dedup.exact_groups(none).count() == 0
    assert sharding.shard(none).count() == 0
    assert mixing.mix(none, mixing.cyclic_weights(5, 2, 1)).count() == 0
    assert substring_dedup.repeated_passages(none).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(none, items).count() == 0
    some = decontaminate.contamination(frame(spark, corpus()), items)
    assert some.where("contaminated OR n_hit > 0 OR n_items > 0").count() == 0 and some.count() == len(corpus())
    model = quality.train(none, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in quality.score(frame(spark, corpus()[:2]), model, ["doc_id"]).collect()] == [0.5, 0.5]


def test_exact_groups(spark):
    rows = corpus(4) + [(5001, "A  b\tc", "en", "a", 0, "", ""), (5000, "A b c", "en", "a", 0, "", ""), (None, "A b c", "en", "a", 0, "", "")]

    def normal(t):
        return re.sub("[\x20\x09-\x0d]+", " ", t or "")

    groups = {}
    for r in rows:
        groups.setdefault(normal(r[1]), []).append(r[0])
    want = []
    for r in rows:
        g = groups[normal(r[1])]
        keep = min((x for x in g if x is not None), default=None)
        want.append((str(r[0]), str(keep), len(g), r[0] == keep, hashlib.sha256(normal(r[1]).encode()).hexdigest()))
    for content in (exact_dedup.content_hash, lambda text: F.substring(F.md5(text), 1, 1)):  # the second has collisions
        got = exact_dedup.exact_groups(frame(spark, rows), content).collect()
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == sorted(want)


def brute_contamination(rows, items, window):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

    def split(t):
        return pattern.findall((t or "").translate(LOWER))

    windows = []
    for item, text in items:
        w = split(text)
        n = min(window, len(w))
        windows += [(item, w[i : i + n]) for i in range(len(w) - n + 1)] if n else []
    out = []
    for r in rows:
        w, hit, found = split(r[1]), set(), set()
        for item, x in windows:
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit |= set(range(i, i + len(x)))
                    found.add(item)
        ids = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((str(r[0]), len(w), len(hit), len(found - {None}), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_contamination(spark):
    rows = corpus(6, 80)
    rng = random.Random(3)
    items = [(1, "One"), (2, None), (3, "..."), (4, "é-ß TWO three"), (None, "no id at")]
    for i in range(12):
        w = words(rng.choice(rows)[1])
        if len(w) > 4:
            a = rng.randrange(len(w) - 3)
            items.append((10 + i, " ".join(w[a : a + rng.choice([3, 7, 10, 14])]).upper().replace("É", "é")))
    items += items[-2:]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(frame(spark, rows), table, 10).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == brute_contamination(rows, items, 10)


def test_passages_over_fifty_words_are_found(spark):
    rng = random.Random(8)

    def text(n):
        return ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n)]

    passages = [text(n) for n in (51, 60, 90)]
    edited = passages[2].copy()
    edited[20], edited[21] = "changed", "words"
    rows, holders = [], {}
    for i in range(60):
        body = text(rng.choice([10, 80, 400]))
        if i % 4 == 0:
            p = (i // 4) % 3
            at = rng.randrange(len(body))
            body[at:at] = edited if p == 2 and i > 30 else passages[p]
            holders.setdefault(p, set()).add(i)
        rows.append((i, " ".join(body), "en", "a", 0, "", ""))
    rows += [(None, rows[0][1], "", "", 0, "", ""), (100, None, "", "", 0, "", ""), (101, "short", "", "", 0, "", ""), rows[0]]
    got = substring_dedup.repeated_passages(frame(spark, rows)).collect()
    assert {r.doc_id for r in got} == set().union(*holders.values())
    assert all(r.n_words >= 50 and r.similarity >= 0.8 for r in got)


def test_compact_windows_are_spans_of_the_cartesian_tree():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (3, 10, 57, 200):
        values, first = rng.integers(0, 50, n).astype(np.uint64), np.array([0, n // 3, n])
        got = set(zip(*(x.tolist() for x in substring_dedup.compact_windows(values, first, 4)), strict=True))
        want = set()
        for row, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
            v = values[a:b].tolist()
            for c in range(len(v)):
                left = next((i + 1 for i in range(c - 1, -1, -1) if v[i] <= v[c]), 0)
                right = next((i - 1 for i in range(c + 1, len(v)) if v[i] < v[c]), len(v) - 1)
                if right - left + 1 >= 4:
                    want.add((row, left, c, right))
        assert got == want


def test_mix_meets_targets_and_reruns_agree(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 30, 200])), "", rng.choice(["a"] * 8 + ["b", "c", "é", "𝄞", None]), 0, "", "") for i in range(1500)]
    docs = frame(spark, rows)
    got = mixing.mix(docs, mixing.cyclic_weights(5, 2, 1)).collect()
    again = mixing.mix(docs.repartition(7), mixing.cyclic_weights(5, 2, 1)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    sizes, targets, taken = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        targets[r.source] = r.target
        assert r.taken <= 2 * r.size and r.taken == r.size * r.taken_times
    names = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, want, capped = 1.5 * sum(sizes.values()), {}, set()
    while True:  # rounds of clamping and resharing
        rest = budget - sum(2 * sizes[s] for s in capped)
        level = rest / sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and weight[s] * level > 2 * sizes[s]}
        if not over:
            want = {s: 2 * sizes[s] if s in capped else weight[s] * level for s in names}
            break
        capped |= over
    for s in names:
        assert abs(targets[s] - want[s]) < 1e-6 * want[s]
        assert abs(taken[s] - targets[s]) <= max(2, 0.01 * targets[s])


def test_mix_edge_cases(spark):
    got = mixing.mix(frame(spark, corpus(9)), mixing.cyclic_weights(5, 2, 1)).collect()
    assert len(got) == len(corpus(9)) and all(r.taken <= 2 * r.size for r in got)


def test_shards_are_contiguous_and_balanced(spark):
    rows = corpus(5, 600) + [(7000 + i, "the same text", "en", "a", 0, "", "") for i in range(900)]
    for whole in (0.05, 0.0):
        got = sharding.shard(frame(spark, rows), 8, whole, ["lang"]).collect()
        assert len(got) == len(rows)
        sizes, texts = [0] * 8, {}
        for shard in range(8):
            mine = [r for r in got if r.shard == shard]
            assert sorted(r.slot for r in mine) == list(range(len(mine)))
            sizes[shard] = sum(r.size for r in mine)
        assert max(sizes) - min(sizes) <= 2 * max(r.size for r in got) + 0.1 * sum(sizes) / 8
        by_id = {r[0]: r[1] for r in rows}
        for r in got:
            if r.doc_id is not None:
                data = (by_id[r.doc_id] or "").encode()
                assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
                texts.setdefault(by_id[r.doc_id], set()).add(r.shard)
        if whole:
            total = sum(sizes) / 8
            for t, shards in texts.items():
                together = sum(len((x[1] or "").encode()) + 8 for x in rows if x[1] == t)
                assert len(shards) == 1 or together > whole * total


def test_links_of_pages(spark):
    link = '<link rel="canonical" href="%s">'
    cases = [
        ("http://h.org/a/b", "c.html", "h.org/a/c.html"), ("http://h.org/a/b", "?x=2", "h.org/a/b?x=2"), ("http://h.org", "c", "h.org/c"), ("http://h.org/a/b?q", "../c?y#z", "h.org/c?y"),
        ("http://h.org/a/", "./.", "h.org/a/"), ("http://h.org/a/b", "../../..", "h.org/"), ("https://h.org/a", "//i.org/k", "i.org/k"), ("http://h.org/a", "/r", "h.org/r"),
        ("http://h.org/a", "x?u=http://y.org/", "h.org/x?u=http://y.org/"), ("http://h.org/a", "#top", None), ("http://h.org/a", "mailto:x@y.org", None),
    ]
    table = spark.createDataFrame([(url, link % to) for url, to, _ in cases], "url string, html string")
    assert sorted(r.b for r in url_filter.page_links(table).collect()) == sorted(b for _, _, b in cases if b)
    both = spark.createDataFrame([("http://h.org/a", link % "/1" + link % "/2" + '<meta http-equiv="refresh" content="0; url=/3">')], "url string, html string")
    assert sorted(r.b for r in url_filter.page_links(both).collect()) == ["h.org/1", "h.org/2", "h.org/3"]


def test_rules_and_aliases(spark):
    link = '<html><head><link rel="canonical" href="%s"></head></html>'
    pages = [
        (1, "https://a.example.com/en/1", "x"), (2, "http://www.example.com/en/1", None), (3, "HTTP://WWW.Example.ORG/a?b#c", link % "http://spam.net/fr/9"),
        (4, "http://other.org/z", link % "http://www.example.org/a?b"), (5, "http://mixed.org/q", link % "http://spam.net/fr/1"), (6, "http://mixed2.org/q", link % "http://mixed.org/q"),
        (7, "http://mixed2.org/q", '<meta http-equiv="refresh" content="0; url=https://fine.com/a">'), (8, None, None), (9, "nothing", ""), (10, "http://net/es/", None), (11, "http://notnet/es/", None),
        (12, "http://com?x", None), (12, "http://com?x", None), (13, "ftp://user@Host.COM:80/p", link % "/relative"),
    ]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(table, url_filter.rules_table(spark, url_filter.RULES)).collect()}
    assert got[1] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert got[2] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[3] == ("www.example.org", "/a", None, "block") and got[4][3] == "block", "an alias of an alias"
    assert got[5][3] == got[6][3] == got[7][3] == "allow", "an allowed alias comes before a blocked one"
    assert got[8] == got[9] == ("", "", None, "allow")
    assert got[10][2:] == ("net/es/", "block") and got[11][2:] == (None, "allow")
    assert got[12] == ("com", "", None, "allow") and got[13] == ("user@host.com:80", "/p", None, "allow")
    assert url_filter.filter_urls(table.limit(0), url_filter.rules_table(spark, url_filter.RULES)).count() == 0


def test_components_of_paths_and_stars(spark):
    from hearthlake.llm.components import components

    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(4)
    long = "".join(rng.choice("abcé \r\n") for _ in range(200_000))
    pages = [(1, "http://a/ b\r\nX: y", "same"), (5, "http://a", "same"), (3, None, "same"), (4, "u", None), (6, "u", ""), (7, "u", long), (8, "u", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n"), (None, "u", "none"), (9, "u", "none"), (10, "u", "é")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    files = warc.write_archives(warc.records(table), folder, chunk=1000)
    rows = warc.read_archives(files, folder, chunk=777).collect()
    whole = {}
    for r in sorted(rows, key=lambda r: (r.record_id, r.chunk_no)):
        whole.setdefault(r.record_id, []).append(r)
    assert len(whole) == len(pages)
    for page_id, _, html in pages:
        parts = whole[warc._name(page_id).strip("<>")]
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert [p.chunk_no for p in parts] == list(range(len(parts))) and [p.last for p in parts] == [False] * (len(parts) - 1) + [True]
        assert parts[0].stated_digest == digest and parts[0].stated_bytes == len(data)
        if page_id in (1, 3, 4, None):
            assert parts[0].record_type == "revisit" and parts[0].refers_to == f"urn:page:{ {1: 5, 3: 5, 4: 6, None: 9}[page_id]}"
        else:
            assert parts[0].record_type == "response" and b"".join(p.payload for p in parts) == data
            assert parts[-1].digest_so_far == digest and parts[-1].bytes_so_far == len(data)
            assert all(p.digest_so_far == base64.b32encode(hashlib.sha1(data[: p.bytes_so_far]).digest()).decode() for p in parts)
    assert warc.read_archives(warc.write_archives(warc.records(table.limit(0)), f"{folder}2"), f"{folder}2").count() == 0


def test_quality_tells_junk_from_prose(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        n = rng.choice([20, 80, 300])
        prose = " ".join("".join(rng.choice("etaoinsh") for _ in range(rng.randint(2, 8))) for _ in range(n)).capitalize() + "."
        junk = i % 3 == 0
        rows.append((i, re.sub(" ", rng.choice(["*** ", "### ", " | "]), prose) if junk else prose, "en", "a", 0, "", ""))
        labels.append((i, 0 if junk else 1))
    rows += [(1000, None, "", "", 0, "", ""), (1001, "", "", "", 0, "", ""), (1002, "x " * 50_000, "", "", 0, "", "")]
    docs, table = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.train(docs, quality.learnable(table))
    got = {r.doc_id: r.score for r in quality.score(docs, model, ["doc_id"]).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 30 and all((got[i] >= 0.3) == bool(y) for i, y in labels if i in held)
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == len(rows)
    below = sum(got[i] < model.cut for i, _ in labels) / len(labels)
    assert abs(below - 1 / 3) < 0.05, "the cut is the quantile of the labels"


def test_hashes_of_words_and_shingles():
    import numpy as np
    import pyarrow as pa

    texts = ["Ab c", None, "", "ab  C\n", "é ß ab", "a" * 70_000 + " b"] * 3
    seen = {}
    for lo, hi, data, at in kernels.chunks(pa.array(texts).slice(1), 64):
        w = kernels.split(data, at, kernels.BY_SPACE)
        for r in range(lo, hi):
            mine = words(texts[r + 1])
            a, b = w.first[r - lo], w.first[r - lo + 1]
            assert b - a == len(mine)
            for word, h in zip(mine, w.hashes[a:b].tolist(), strict=True):
                assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    assert np.all(np.diff(w.first) >= 0)


def test_crowded_columns_equal_brute_force(spark):
    """Many copies of one text that differ from one another: the token-group matrix decides what is compared."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(150):
        w = base.copy()
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
            w[rng.randrange(150)] = f"e{rng.randrange(60)}"
        if i % 10 == 0:
            w = w[: rng.randint(110, 150)]
        rows.append((i, " ".join(w), "en", "a", 0, "", ""))
    rows += corpus(11, 40)
    want = brute_components(rows, 4, 85)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(frame(spark, rows), 4, 85).collect()}
    assert {k: v for k, v in got.items() if k is not None} == want and len(set(want.values())) > 20
