"""The text operators against brute force on small fixtures with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("raincask.llm")
from raincask.llm import common, components, decontamination, exact_dedup, lm_score, near_dedup, packing, pii, quality, sharding, simhash, substring_dedup, suffix_dedup  # noqa: E402

R = random.Random(7)
VOCABULARY = ["".join(R.choice("abcdefgé") for _ in range(R.randint(1, 7))) for _ in range(400)]


def prose(n: int) -> str:
    return " ".join(R.choice(VOCABULARY) for _ in range(n))


PASSAGE = prose(120)
TEXTS = [prose(R.randint(5, 160)) for _ in range(40)]
TEXTS += [prose(20) + " " + PASSAGE + " " + prose(20), PASSAGE, prose(9) + "\n\t" + PASSAGE, "A" + prose(30) + PASSAGE[100:700]]
TEXTS += [TEXTS[0], TEXTS[0], TEXTS[1], None, None, "", " \n ", "x", "ab " * 500, "z" * 1500, prose(6000)]
ODD = "doc_id long, text string, row string, key long, _mask int, _pos int, th int, fp string"


def odd_rows(spark, rows):
    """Rows whose extra columns have the names that operators and stages use inside."""
    return spark.createDataFrame([(i, t, "r", 1, 2, 3, 4, "f") for i, t in rows], ODD)


ROWS = [(i * 3 + 1, t, "a", 7) for i, t in enumerate(TEXTS)]
#: Extra columns have names that the operators use inside.
SCHEMA = "doc_id long, text string, spans string, th int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


def test_exact_dedup(docs, empty, spark):
    groups = defaultdict(list)
    for i, t, *_ in ROWS:
        groups[t or ""].append(i)
    text = {i: t or "" for i, t, *_ in ROWS}
    out = exact_dedup.exact_dedup(docs).collect()
    assert len(out) == len(ROWS)
    for r in out:
        g = groups[text[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(g), len(g), r.doc_id == max(g), hashlib.sha256(text[r.doc_id].encode()).hexdigest())
    assert exact_dedup.exact_dedup(empty).count() == 0
    odd = spark.createDataFrame([(None, "a"), (1, "a"), (2, "a"), (2, "a"), (None, "b")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup.exact_dedup(odd).collect()) == [(0, 0, 1, True), (0, 2, 4, False), (1, 2, 4, False), (2, 2, 4, False), (2, 2, 4, True)]


def test_exact_dedup_of_a_hot_group_and_a_full_filter(spark):
    df = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"t{i // 2}") for i in range(900)], "doc_id long, text string")
    out = exact_dedup.exact_dedup(df, bits_per_row=1, most_bits=1024).collect()
    assert len(out) == 900 and {r.keep_id for r in out if r.group_size == 300} == {897}


def test_suffix_array_dedup(docs, empty):
    least = 100
    data = [(t or "").encode() for _, t, *_ in ROWS]
    seen = Counter(d[k : k + least] for d in data for k in range(len(d) - least + 1))
    out = {r.doc_id: r for r in suffix_dedup.suffix_array_dedup(docs, least=least).collect()}
    for (i, *_), d in zip(ROWS, data):
        gone = bytearray(len(d))
        for k in range(len(d) - least + 1):
            if seen[d[k : k + least]] > 1:
                gone[k : k + least] = b"\1" * least
        runs = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        r = out[i]
        assert r.n_bytes == len(d) and [(s.start, s.stop) for s in r.spans] == runs
        assert bytes(r.kept) == bytes(b for b, g in zip(d, gone) if not g)
    assert suffix_dedup.suffix_array_dedup(empty, least=least).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.suffix_array_dedup(docs, least=10)


def test_suffix_family_keeps_logarithmic_levels_in_byte_order():
    family, rng, seen, matched = suffix_dedup.SuffixFamily(), np.random.default_rng(1), [], set()
    for n in range(13):
        batch = np.array([bytes(x) for x in rng.integers(97, 105, (50, 3)).astype(np.uint8)], "S32")
        seen += batch.tolist()
        matched |= set(family.add(batch).tolist())
        assert len(family.levels) == bin(n + 1).count("1")
        assert all(k.tolist() == sorted(k.tolist()) == [seen[e] for e in at] for k, at in family.levels.values())
    counts = Counter(seen)
    assert matched == {i for i, v in enumerate(seen) if counts[v] > 1}


@pytest.mark.parametrize("least", [64, 72, 100, 400])
def test_prefix_ranks_order_by_bytes(least):
    data = np.random.default_rng(least).integers(97, 100, 2500).astype(np.uint8)
    data[1000:1600], data[2000:2090] = data[:600], data[50:140]
    text = data.tobytes() + b"\0" * least
    prefix = [text[k : k + least] for k in range(len(data))]
    rank = suffix_dedup.prefix_ranks(data, least).tolist()
    place = {}
    for k, p in enumerate(sorted(prefix)):
        place.setdefault(p, k)
    assert rank == [place[p] for p in prefix]


def test_marks_show_every_repeat_of_the_reported_length(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "FLUSH_BYTES", 3000)
    passages = [prose(60).encode()[:n].decode(errors="ignore") for n in (256, 270, 300, 390)]
    rows = [(2 * i + k, prose(30) + p + prose(30)) for i, p in enumerate(passages) for k in (0, 1)] + [(100 + i, "%030d" % i + "".join(R.choice("xyzw") for _ in range(900))) for i in range(30)]
    out = {r.doc_id: r for r in suffix_dedup.suffix_array_dedup(odd_rows(spark, rows)).collect()}
    assert all(out[i].n_shared > 0 and not out[i].spans for i in range(2, 8)) and all(out[i].n_shared == 0 for i in out if i >= 100)
    assert all(r.n_shared == 0 for r in suffix_dedup.suffix_array_dedup(odd_rows(spark, rows), report=0).collect())


def test_substring_dedup(docs, empty):
    w, n = {i: words(t) for i, t, *_ in ROWS}, 13
    first = {}
    for i, x in sorted(w.items()):
        for k in range(len(x) - n + 1):
            first.setdefault(tuple(x[k : k + n]), i)
    for r in substring_dedup.substring_dedup(docs).collect():
        x = w[r.doc_id]
        gone = {j for k in range(len(x) - n + 1) if first[tuple(x[k : k + n])] < r.doc_id for j in range(k, k + n)}
        assert r.n_words == len(x) and {j for s in r.spans for j in range(s.start, s.stop)} == gone
        assert r.kept_text.encode() == b" ".join(v for j, v in enumerate(x) if j not in gone)
    assert substring_dedup.substring_dedup(empty).count() == 0


def anchors_of(text, field):
    offsets, data = common.raw_bytes(text)
    order = common.rare_first(suffix_dedup.gram_hashes(data), field)
    return order[suffix_dedup.segments(offsets, order, 400)[3]]


def minimisers_of(text, field):
    words, counts = substring_dedup.words_of(text)
    return substring_dedup.super_kmers(substring_dedup.word_hashes(words), counts, 13, 3, field)[3]


@pytest.mark.parametrize(("grams", "meets"), [(substring_dedup.all_word_grams(3), minimisers_of), (suffix_dedup.all_grams, anchors_of)])
def test_strings_around_a_common_line_do_not_meet_in_one_bucket(spark, grams, meets):
    import pyarrow as pa

    line = prose(40)
    rows = [(i, prose(90) + " " + line + " " + prose(90)) for i in range(300)]
    field = common.common_grams(spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", F.xxhash64("text")), len(rows), grams)
    text = pa.array([t for _, t in rows])
    assert Counter(meets(text, None).tolist()).most_common(1)[0][1] > 60
    # Strings with a rare gram meet at that one; those within the line, equal ones, still meet at a common one.
    assert all(n < 20 for h, n in Counter(meets(text, field).tolist()).items() if not h >> 63)


@pytest.mark.parametrize("share", [0.0, 0.02])
def test_results_do_not_depend_on_what_is_common(docs, monkeypatch, share):
    plain = {r.doc_id: r for r in suffix_dedup.suffix_array_dedup(docs, least=100).collect()}, {r.doc_id: r for r in substring_dedup.substring_dedup(docs).collect()}
    monkeypatch.setattr(common, "COMMON_SHARE", share)
    monkeypatch.setattr(common, "LEAST_COMMON", 2)
    assert {r.doc_id: r for r in suffix_dedup.suffix_array_dedup(docs, least=100).collect()} == plain[0]
    assert {r.doc_id: r for r in substring_dedup.substring_dedup(docs).collect()} == plain[1]


def test_golay_keys_find_all_near_fingerprints():
    rng, table = np.random.default_rng(3), simhash.error_table()
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    for bits in range(5):
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in a], np.uint64)
        keys = [defaultdict(set), defaultdict(set)]
        for side, x in zip(keys, (a, a ^ flips)):
            for row, key in zip(*simhash.composite_keys(x, table)):
                side[int(row)].add(int(key))
        assert all(keys[0][i] & keys[1][i] for i in range(len(a)))


def test_group_links_span_what_is_linked():
    rng = np.random.default_rng(5)
    x = np.unique(np.concatenate([c ^ np.array([sum(1 << int(b) for b in rng.choice(20, rng.integers(0, 5), replace=False)) for _ in range(60)], np.uint64) for c in rng.integers(0, 2**63, 3).astype(np.uint64)]))
    pairs = np.argwhere(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4)
    u, v = simhash.group_links(x, 4)
    assert (simhash.forest(u, v, len(x)) == simhash.forest(pairs[:, 0], pairs[:, 1], len(x))).all()


def test_simhash_components(docs, empty):
    import xxhash

    def fingerprint(t):
        x = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = [b" ".join(x[k : k + 4]) for k in range(len(x) - 3)] or ([b" ".join(x)] if x else [])
        h = [xxhash.xxh64_intdigest(v, 42) for v in s]
        return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))

    fp = {i: fingerprint(t) for i, t, *_ in ROWS}
    least = {i: i for i in fp}
    changed = True
    while changed:
        changed = False
        for i in fp:
            for j in fp:
                if bin(fp[i] ^ fp[j]).count("1") <= 4 and least[j] < least[i]:
                    least[i], changed = least[j], True
    for r in simhash.simhash_components(docs).collect():
        assert (r.fp & (2**64 - 1), r.component_id) == (fp[r.doc_id], least[r.doc_id])
    assert simhash.simhash_components(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (3, 2)]
    root = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert {root[i] for i in range(61)} == {0} and {root[i] for i in range(100, 140)} == {100}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_copies(spark):
    base = [prose(120).split() for _ in range(6)]
    rows, i = [], 0
    for b in base:
        for edits in (0, 1, 2, 12):
            x = list(b)
            for k in R.sample(range(len(x)), edits):
                x[k] = R.choice(VOCABULARY) + "q"
            rows.append((i, " ".join(x)))
            i += 1
    rows += [(900, ""), (901, None), (None, "x")]
    sets = {i: {" ".join((t or "").split()[k : k + 5]) for k in range(max(0, len((t or "").split()) - 4))} for i, t in rows}
    gone = {r.doc_id: r.keep_id for r in near_dedup.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sim = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 1.0
    root = {i: i for i in sets if i is not None}
    for _ in root:
        for a in root:
            for b in root:
                if sim(a, b) >= 0.8:
                    root[a] = root[b] = min(root[a], root[b])
    assert gone == {i: r for i, r in root.items() if r != i}


@pytest.mark.parametrize("limits", [{"GROUP": 8}, {"GROUP_BYTES": 4000}])
def test_near_copies_in_rounds(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(near_dedup, name, value)
    words = prose(200).split()
    rows = [(i, " ".join(w if k != 7 * i % 190 else "edit" for k, w in enumerate(words))) for i in range(40)]
    pair = prose(150)
    rows += [(100, pair), (101, pair + " more"), (102, None), (103, "")]
    gone = {r.doc_id for r in near_dedup.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert gone == {*range(1, 40), 101, 103}


@pytest.mark.parametrize("limits", [{"GROUP": 6}, {"GROUP_BYTES": 6000}])
def test_near_copies_of_a_large_component_are_those_of_a_small_one(spark, monkeypatch, limits):
    words = prose(200).split()
    # A chain: each text is close to its neighbours alone, so a text lost with its neighbour leaves a link undecided.
    rows = [(i, " ".join("new" + w if k < 6 * i else w for k, w in enumerate(words))) for i in range(24)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    small = {r.doc_id: r.keep_id for r in near_dedup.near_copies(frame).collect()}
    assert len(small) > 15
    for name, value in limits.items():
        monkeypatch.setattr(near_dedup, name, value)
    assert {r.doc_id: r.keep_id for r in near_dedup.near_copies(frame).collect()} == small


def test_near_copies_with_blocks_appended_cut_or_replaced(spark):
    rows = []
    for k in range(60):
        words = prose(R.choice((30, 120, 400))).split()
        n = len(words) * R.choice((5, 10, 15, 20)) // 100
        other = {0: words + prose(n + 1).split(), 1: words[n:], 2: words[:-n], 3: words[: len(words) // 2] + prose(n // 2 + 1).split() + words[len(words) // 2 + n // 2 + 1 :]}[k % 4]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    near = {2 * k + 1: 2 * k for k in range(60) if len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) >= 0.8}
    assert len(near) > 30
    assert {r.doc_id: r.keep_id for r in near_dedup.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == near


def test_decontamination(spark):
    item = "We know that in the year of the flood old Bob had 5 red apples and he ate 2 of them while Bob gave 1 to his friend"
    bench = spark.createDataFrame([(1, item), (2, "Too short"), (3, None)], "item_id long, text string")
    rows = [
        (1, "so. " + item.replace("the year", "The YEAR,") + " and so on"), (2, "see we know that in the year of the flood old Eve had 17 red apples and he ate 9 of them while Eve gave 8 to his friend"),
        (3, prose(60)), (4, None), (5, ""), (6, "we know that in the year of the flood nothing else happened at all in town"), (None, item + "!"), (1, "so. " + item.replace("the year", "The YEAR,") + " and so on"),
    ]
    out = decontamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    got = sorted(((r.doc_id or 0), r.contaminated, list(r["items"])) for r in out.collect())
    assert got == [(0, True, [1]), (1, True, [1]), (1, True, [1]), (2, True, [1]), (3, False, []), (4, False, []), (5, False, []), (6, False, [])]
    none = decontamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench.limit(0))
    assert none.where("contaminated").count() == 0 and none.count() == len(rows)


def found_items(spark, texts, items):
    out = decontamination.decontaminate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    return {r.doc_id: list(r["items"]) for r in out.collect()}


def test_items_are_found_after_any_text(spark):
    items = ["What is the capital of France?", "Name the five longest rivers of old Europe in order of their length", "Second place went to nobody else"]
    before = ("", "1) ", "A heading\n", "they asked us ", "it took 5 ")
    texts = [b + i + a for i in items for b in before for a in ("", " Then more.")] + ["1) What is the capital of Spain?", "they said Paris is the capital of France?", "WHAT IS THE CAPITAL OF FRANCE"]
    n = len(before) * 2
    assert found_items(spark, texts, items) == {**{k: [k // n] for k in range(3 * n)}, 3 * n: [0], 3 * n + 1: [], 3 * n + 2: [0]}


@pytest.mark.parametrize("item", ["12 + 7 = ?", "1 2 3 5 8 13 21 34", "Ann Bob Carl Dora Eve Fred Gina", "Who wrote Hamlet?", "! ?"])
def test_items_of_few_words_or_letters_are_found_word_for_word(spark, item):
    assert found_items(spark, [item, "so 3) " + item + " End", prose(40)], [item]) == {0: [0], 1: [0], 2: []}


def test_short_items_beside_others(spark):
    items = ["12 + 7 = ?", "The river runs from the lake to the sea"]
    assert found_items(spark, ["see 12 + 7 = ?", "see 13 + 7 = ?", "and the river runs from the lake to the sea", "nothing"], items) == {0: [0], 1: [0], 2: [1], 3: []}


def decontaminated(texts, items, length=13):
    """Brute force: every window of every text against every window of every item in each of its forms."""
    sub, d = pytest.importorskip("regex").sub, decontamination

    def plain(t):
        return sub(d._OUTER, "", sub("[<>]", "^", t).lower()).split()

    def template(t):
        t = sub(d._NUMBER, "<num>", sub(d._DIGITS, "<num>", sub(d._NAME, "<name>", sub("[<>]", "^", t)).lower()))
        return sub(d._OUTER, "", sub(d._UNIT, r"\1<unit>", t)).split()

    def slots_agree(form, theirs, mine):
        given = defaultdict(set)
        for f, a, b in zip(form, theirs, mine):
            if "<" in f:
                given[a.lower()].add(b.lower())
        return all(len(v) == 1 for v in given.values())

    windows = set()
    for item_id, text in enumerate(items):
        raw, own, bare = (text or "").split(), template(text or ""), plain(text or "")
        size = min(len(raw), length)
        for i in range(len(raw) - size + 1) if size else ():
            first = {tuple(template(before + raw[i])[-1:]) for before in ("", "x ", "1 ")}
            cut = tuple(own[i : i + size])
            forms = {(0, cut)} | {(1, f + cut[1:]) for f in first - {cut[:1]}}
            forms = {(how, f) for how, f in forms if size >= 5 and sum("<" not in w for w in f) * 2 >= size} | {(2, tuple(bare[i : i + size]))}
            windows |= {(item_id, tuple(raw[i : i + size]), cut, how, f, bare[i]) for how, f in forms}
    out = []
    for text in texts:
        raw, own, bare = (text or "").split(), template(text or ""), plain(text or "")
        met = {}
        for item_id, theirs, cut, how, form, first in windows:
            for at in range(len(raw) - len(form) + 1):
                mine = raw[at : at + len(form)]
                if tuple((bare if how == 2 else own)[at : at + len(form)]) == form and (how != 1 or bare[at] == first) and slots_agree(form, theirs, mine):
                    met[at, item_id, theirs, cut] = [w.lower() for w in mine] == [w.lower() for w in theirs]
        out.append((bool(met), len(met), sum(met.values()), sorted({m[1] for m in met})))
    return out


def test_decontamination_against_brute_force(spark):
    rng = random.Random(11)
    few = ["the", "river", "had", "Bob", "Eve", "five", "12", "7.5", "km", "apples.", "and", "(then)", "London", "in", "gave", "hours", "?", "a<b"]
    items = [" ".join(rng.choice(few) for _ in range(n)) for n in (1, 3, 4, 5, 6, 9, 13, 14, 20, 30)] + [None, "", "the river had the river had the river had the river had the river had"]
    texts = [None, "", " ".join(few)]
    for _ in range(60):
        own = (items[rng.randrange(3, 10)] + " ").split()
        changed = [{"Bob": "Ann", "Eve": "Ann", "12": "44", "five": "9", "km": "miles"}.get(w, w) if rng.random() < 0.7 else w for w in own]
        texts.append(" ".join(rng.choice(few) for _ in range(rng.randrange(6))) + " " + " ".join(changed if rng.random() < 0.6 else own) + rng.choice(["", ".", " and the rest"]))
    texts.append(" ".join(items[-1].split() * 20))
    out = decontamination.decontaminate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    got = {r.doc_id: (r.contaminated, r.n_windows, r.n_verbatim, list(r["items"])) for r in out.collect()}
    want = decontaminated(texts, items)
    assert got == dict(enumerate(want))
    assert 20 < sum(w[0] for w in want) and any(w[2] < w[1] for w in want)


def test_slots_have_to_be_consistent(spark):
    item = "then it was Bob who had five and it was then Bob who ate"
    same, mixed = item.replace("Bob", "Eve"), item.replace("Bob", "Eve", 1).replace("Bob", "Ann")
    out = decontamination.decontaminate(spark.createDataFrame([(1, same), (2, mixed)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"), length=14)
    assert {r.doc_id: r.contaminated for r in out.collect()} == {1: True, 2: False}


def test_packing(docs, empty, spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tok, cap = Tokenizer.from_file(path("byte_bpe_50k.json")), 200
    rows = ROWS + [(9001, "a  b\n\n c<|endoftext|> d e 　 f it's 12 34é", "", 0), (9002, " <|endoftext|>", "", 0)]
    out = packing.pack(spark.createDataFrame(rows, SCHEMA), capacity=cap, with_ids=True).collect()
    by, seq, total = defaultdict(list), defaultdict(list), 0
    for r in out:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for i, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        pieces = sorted(by[i], key=lambda r: r.piece)
        assert [x for p in pieces for x in p.ids] == ids and [p.piece for p in pieces] == list(range(len(pieces)))
        assert all(p.length == cap for p in pieces[1:]) and all(zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 for p in pieces)
    for s in seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= cap
    assert len(seq) <= 1.02 * total / cap + 1
    assert packing.pack(empty).count() == 0


def test_plan_places_each_piece_once():
    rng = random.Random(2)
    for capacity in (7, 50, 2048):
        count = Counter(rng.randint(1, capacity) for _ in range(500))
        plan = packing.make_plan(dict(count), capacity)
        placed = Counter()
        for slots, bins in plan.groups:
            assert sum(a * t for a, t in slots) <= capacity
            for a, t in slots:
                placed[a] += t * bins
        assert placed == count and plan.bins >= -(-sum(a * n for a, n in count.items()) // capacity)


def test_reduction_is_optimal_where_pairs_decide():
    plan, count = packing.Plan(), {6: 2, 4: 1, 3: 1, 9: 1}
    packing.reduce_instance(count, 10, plan)
    assert not count and plan.bins == 3


def test_lm_score(docs, empty):
    w = {i: words(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t, *_ in ROWS}
    own = {i: Counter(tuple(x[k : k + n]) for n in (1, 2, 3) for k in range(len(x) - n + 1)) for i, x in w.items()}
    every, size = sum(own.values(), Counter()), sum(map(len, w.values()))
    for r in lm_score.lm_score(docs).collect():
        x, c = w[r.doc_id], lambda g: every[g] - own[r.doc_id][g]  # noqa: B023
        total = 0.0
        for k in range(len(x)):
            s = (c((x[k],)) or 0.5) / max(size - len(x), 1)
            for n in (2, 3):
                if k >= n - 1:
                    g = tuple(x[k - n + 1 : k + 1])
                    s = c(g) / c(g[:-1]) if c(g) else 0.4 * s
            total += math.log(s)
        assert r.n_words == len(x) and r.log_score == pytest.approx(total, abs=1e-6)
    assert lm_score.lm_score(empty).count() == 0


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def passes(kind, v):
    d = re.sub(r"\D", "", v)
    luhn = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (c > "4") for i, c in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": all(int(x) <= 255 for x in v.split(".")) if kind == "ip" else True, "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]


def test_pii_base_spans(spark, empty):
    bits = ["4539578763621486", "4539 5787-6362 1486", " ", "-", "1.2.3.4", ".5", "a@b.c", "@d.e", "_x", "+1 (743) 555-3824", "é", "300.1.1.1", "😀", "12", "+", "(743) 555-3824 ", "joe (at) mail (dot) com "]
    rows = [(i, "".join(R.choice(bits) for _ in range(R.randint(0, 12)))) for i in range(400)] + [(500, None), (501, "")]
    out = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        expected = sorted((m.start(), k, m.end()) for k, (name, p) in enumerate(BASE) for m in re.finditer(p, t or "") if passes(name, m.group()))
        assert [(s.start, s.kind, s.stop) for s in out[i].base] == expected
        assert set(map(tuple, out[i].base)) <= set(map(tuple, out[i].spans))
    assert pii.find_pii(empty).count() == 0


def test_pii_classifier_decides_on_secrets_and_loose_numbers(spark):
    hexes = lambda n: "".join(R.choice("0123456789abcdef") for _ in range(n))
    good = [f'token = "{hexes(40)}"' for _ in range(40)] + [f"api_key: sk-{hexes(30)}" for _ in range(20)] + [f"call (743) 555-{k:04d} now" for k in range(2000, 2030)]
    bad = [f"the file path/to/some/{w}1/of/these" for w in VOCABULARY[:30] if w.isascii()] + [f"commit {hexes(12)}-{hexes(4)}-{hexes(4)}x now" for _ in range(10)] + [f"order 0{R.randrange(10**14):014d}" for _ in range(40)]
    rows = [(i, prose(10) + " " + t + " " + prose(10)) for i, t in enumerate(good + bad)]
    out = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    added = {i: len(set(map(tuple, r.spans)) - set(map(tuple, r.base))) for i, r in out.items()}
    recall = np.mean([added[i] == 1 for i in range(len(good))])
    wrong = [i for i in range(len(good), len(rows)) if added[i]]
    assert recall > 0.95 and len(wrong) < 0.1 * len(bad)


def test_pii_on_odd_rows(spark):
    rows = [(None, "a@b.c"), (1, None), (1, "a@b.c"), (1, "a@b.c"), (2, "x" * 200_000 + " 1.2.3.4"), (3, "9" * 100_000)]
    out = pii.find_pii(odd_rows(spark, rows)).collect()
    assert Counter((r.doc_id, len(r.base)) for r in out) == Counter([(None, 1), (1, 0), (1, 1), (1, 1), (2, 1), (3, 0)])


def test_expectation_maximisation_tells_good_labelers():
    rng = random.Random(4)
    rows = Counter()
    for _ in range(4000):
        true = rng.random() < 0.4
        sure = lambda p: (1 if true else -1) if rng.random() < p else (-1 if true else 1)  # noqa: B023, E731
        rows[(sure(0.95), sure(0.9), sure(0.55), 0)] += 1
    _, rate, share = pii.expectation_maximisation(list(rows.items()))
    assert share == pytest.approx(0.4, abs=0.05) and rate[0][1][1] > 0.9 and rate[2][1][1] < 0.65


def test_quality(spark, empty):
    good = [(i, prose(R.randint(20, 90)).capitalize() + ".") for i in range(0, 200)]
    bad = [(i, " ".join(w.upper() + "!!" for w in prose(R.randint(20, 90)).split())) for i in range(200, 300)]
    docs = spark.createDataFrame(good + bad + [(900, None), (901, ""), (None, "x"), (902, "z" * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(300)] + [(1, None)], "doc_id long, quality int")
    out = quality.score_quality(docs, labels).collect()
    assert len(out) == 304 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)
    assert np.mean([r.predicted == int(r.doc_id < 200) for r in held]) > 0.95
    assert quality.score_quality(empty, labels).count() == 0
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_sharding(spark, empty):
    rows = [(i, prose(R.randint(1, 60)) if i % 3 else "copy") for i in range(3000)] + [(5000, None), (None, "y"), (7, prose(2))]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).collect()
    assert len(out) == len(rows)
    size, slots = defaultdict(int), defaultdict(list)
    for r in out:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(size) == set(range(8)) and max(size.values()) < 1.05 * min(size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(empty).count() == 0
    # Sizes and checksums by brute force.
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == expected


def test_sharding_of_odd_rows_and_a_hot_group(spark):
    hot = prose(40)
    rows = [(i, hot) for i in range(1000)] + [(2000 + i, prose(40)) for i in range(2000)] + [(None, None), (None, None), (5, hot), (5, hot), (6, ""), (7, "z" * 2_000)]
    out = sharding.shard(odd_rows(spark, rows), shards=8).collect()
    size, slots = defaultdict(int), defaultdict(list)
    for r in out:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    # A third of the rows is one text; no shard is off by more than two hundredths and the longest text.
    share = sum(size.values()) / 8
    assert len(out) == len(rows) and all(abs(v - share) <= 0.02 * share + 2_001 for v in size.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_quality_on_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(40)], "doc_id long, quality int, key string")
    rows = [(i, (prose(40) + ".") if i % 2 else prose(40).upper()) for i in range(40)] + [(None, None), (1, ""), (1, ""), (50, "w " * 60_000)]
    out = quality.score_quality(odd_rows(spark, rows), labels).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows) and all(0 <= r.score <= 1 for r in out)
    scores = defaultdict(list)
    for r in out:
        scores[r.key].append(r.score)
    # Rows with equal id and text score alike; both times one such pair is there.
    assert sorted(map(len, scores.values()))[-1] == 2 and all(len(set(v)) == 1 for v in scores.values())


def test_hash_counts_bound_what_sets_share():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 4000, rng.integers(0, 900)).astype(np.uint64)) for _ in range(40)]
    counts = near_dedup.hash_counts(sets)
    for a in range(40):
        for b in range(40):
            assert np.minimum(counts[a], counts[b]).sum() >= len(np.intersect1d(sets[a], sets[b]))


@pytest.mark.parametrize("least", [0.8, 0.5])
def test_similar_groups_are_those_of_all_pairs(least):
    rng = np.random.default_rng(8)
    base = [np.unique(rng.integers(0, 2**60, 120).astype(np.uint64)) for _ in range(4)]
    sets = [np.unique(np.concatenate([rng.choice(b, len(b) - k, replace=False), rng.integers(0, 2**60, k // 2).astype(np.uint64)])) for b in base for k in rng.integers(0, 30, 25).tolist()] + [np.zeros(0, np.uint64)] * 2
    pairs = np.array([(i, j) for i in range(len(sets)) for j in range(i) if near_dedup.similarity(sets[i], sets[j]) >= least])
    assert (near_dedup.similar_groups(sets, least) == simhash.forest(pairs[:, 0], pairs[:, 1], len(sets))).all()


def test_removal_of_null_and_repeated_ids_among_clashing_columns(spark):
    rows = [(None, "a"), (None, "b"), (1, "a"), (1, "b"), (2, None), (2, "")]
    gone = odd_rows(spark, [(None, "a"), (1, "b"), (2, "")]).select(common.text_key().alias("key"))
    left = common.without(odd_rows(spark, rows), gone)
    assert left.columns == odd_rows(spark, rows).columns
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, "b"), (1, "a")]  # a null text is the empty one
    assert common.without(odd_rows(spark, rows).limit(0), gone).count() == 0


def test_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(20)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    same = prose(60)
    rows = [(None, same), (7, same), (7, same), (7, "other " + prose(30)), (8, None), (9, ""), (None, "z" * 300_000), (None, None), (3, prose(40)), (4, "word " * 40_000)]
    docs = odd_rows(spark, rows)
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        out = stage(spark, docs, str(tmp_path))
        left[name] = Counter((r.doc_id, r["text"]) if "text" in out.columns else r.doc_id for r in out.collect())
        assert out.columns == docs.columns or name == "best-fit packing"
    every = Counter(rows)
    assert left["quality classifier"] == every  # without labels all score a half, which stays
    assert left["exact dedup"] == every - Counter([(None, same), (7, same), (8, None), (None, None)])
    assert left["SimHash near-dedup"] == every - Counter([(9, ""), (None, same), (None, None)])  # of copies the null id goes, rows that repeat stay together
    assert left["benchmark decontamination"] == every
    assert set(left["best-fit packing"]) == {i for i, _ in rows}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = [(i, prose(80).capitalize() + ".", "en", "s", 1) for i in range(60)]
    junk = [(i, prose(80).upper().replace(" ", "!! "), "en", "s", 1) for i in range(100, 140)]
    item = prose(30)
    docs += [(200, docs[3][1], "en", "s", 1), (201, " ".join(docs[4][1].split()[:-1] + ["other."]), "en", "s", 1), (202, docs[5][1] + " " + item, "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs + junk, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 100)) for r in docs[:60] + junk], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path)).cache()
        assert left.columns == [c.split()[0] for c in schema.split(", ")]
        kept.append({r.doc_id for r in left.select("doc_id").collect()})
    assert kept[0] == {r[0] for r in docs} and kept[0] - kept[1] == {3}
    assert kept[1] - kept[2] == {201} and kept[2] - kept[3] == {202}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == kept[3]
