"""Each operator against a brute-force version, an exact round trip or held-out accuracy, on small tables and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from helixframe.llm import decontaminate, media, mixing, near_dedup, pii, quality, token_files, toxicity, url_filter, warc
from helixframe.llm._bits import pack
from helixframe.llm._common import Words, table

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def documents(spark):
    return {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}


@given(st.lists(st.text(), max_size=6))
@settings(max_examples=100, deadline=None)
def test_words(texts):
    w = Words(pa.array(texts, pa.string()))
    got = [[w.data[w.starts[k] : w.ends[k]].tobytes().decode() for k in range(w.first[i], w.first[i + 1])] for i in range(len(texts))]
    assert got == [words(t) for t in texts]
    flat = [x for t in got for x in t]
    assert len(set(flat)) == len(set(w.hashes.tolist()))


# ---------------------------------------------------------------- 1


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        new = [i]
        for j, b in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1]


@given(st.lists(st.integers(0, 2), max_size=14), st.lists(st.integers(0, 2), max_size=14), st.integers(0, 9))
@settings(max_examples=1000, deadline=None)
def test_banded_cost(x, y, more):
    band, real = abs(len(x) - len(y)) + more, distance(x, y)
    assert near_dedup.banded_cost(x, y, band) >= real and (real > band or near_dedup.banded_cost(x, y, band) == real)


@given(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30), st.sampled_from([0.5, 0.7, 0.8, 0.9]))
@settings(max_examples=500, deadline=None)
def test_near(x, y, similarity):
    got = near_dedup.near(np.array(x, np.uint64), np.array(y, np.uint64), similarity)
    assert got == (distance(x, y) <= (1 - similarity) * max(len(x), len(y)) + 1e-9)


def test_near_dedup_finds_all_similar_pairs(spark):
    got = {r.doc_id: r for r in near_dedup.op1_near_dedup(spark, SF).collect()}
    texts = documents(spark)
    assert set(got) == set(texts)
    shingles = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in texts.items() if (w := words(t))}
    places = defaultdict(list)
    for i, s in shingles.items():
        for x in s:
            places[x].append(i)
    pairs = {(a, b) for v in places.values() for a in v for b in v if a < b}
    for a, b in pairs:
        if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
            assert got[a].group_id == got[b].group_id
    together = defaultdict(list)
    for i, r in got.items():
        together[r.group_id].append(i)
    for root, members in together.items():
        assert root == min(members) and [i for i in members if got[i].kept] == [root]
        for i in members:
            assert i == root or any(len(shingles[i] & shingles[j]) >= 0.3 * len(shingles[i] | shingles[j]) for j in members if j != i)


def test_near_dedup_awkward(spark, docs):
    got = {r.doc_id: r for r in near_dedup.groups(docs).collect()}
    assert len(got) == 10
    assert [got[i].group_id for i in (1, 2, 3, 4, 5, 6, 7)] == [1, 1, 1, 4, 5, 6, 6]
    assert [got[i].copy_id for i in (1, 2, 3)] == [1, 2, 1]
    clashing = docs.selectExpr("*", "1 as text_hash", "2 as _doc", "3 as copy_id", "4 as u", "5 as _salt")
    kept = near_dedup.deduplicate(clashing)
    assert kept.columns == clashing.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 8, 9, 10]
    assert near_dedup.groups(docs.limit(0)).count() == near_dedup.deduplicate(docs.limit(0)).count() == 0


def test_near_dedup_of_ids_with_several_texts(spark):
    texts = [" ".join(f"{x}{i}" for i in range(100)) for x in "abc"]
    rows = [(1, texts[0]), (2, texts[1]), (2, texts[2]), (3, texts[0]), (3, texts[0]), (4, texts[1]), (5, texts[2]), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = {r.text: r.h for r in docs.select("text", near_dedup.text_hash().alias("h")).collect()}
    judged = {i: min((t for j, t in rows if j == i), key=hashes.get) for i, _ in rows}
    first = {}
    for i in sorted(judged):
        first.setdefault(judged[i] or i, i)
    want = {i: first[t or i] for i, t in judged.items()}
    assert {r.doc_id: r.group_id for r in near_dedup.groups(docs).collect()} == want
    assert sorted(map(repr, map(tuple, near_dedup.deduplicate(docs).collect()))) == sorted(repr((i, judged[i])) for i in want if want[i] == i)


def edited(r, n, similarity, kind):
    """Random words, and the same with as many random edits as the similarity allows."""
    x = [f"w{r.randrange(10**9)}" for _ in range(n)]
    y = list(x)
    for _ in range(int((1 - similarity) / (similarity if kind == "insert" else 1) * n + 1e-9)):
        how, place = r.choice(("replace", "insert", "delete")) if kind == "mixed" else kind, r.randrange(len(y))
        y[place : place + (how != "insert")] = [] if how == "delete" else [f"e{r.randrange(10**9)}"]
    return " ".join(x), " ".join(y)


def test_near_dedup_recall(spark):
    """At least nine in ten of the pairs with an edit similarity of 0.8 or more are linked, whatever the length and the kind of edit; all pairs of short texts are."""
    r, rows, cells = random.Random(8), [], []
    for n in (1, 4, 6, 9, 12, 20, 40, 60, 75, 100, 200, 600):
        for similarity in (0.8, 0.85, 0.9, 0.95):
            for kind in ("replace", "insert", "delete", "mixed"):
                for _ in range(30):
                    x, y = edited(r, n, similarity, kind)
                    if x != y:
                        cells.append((n, similarity, kind, len(rows)))
                        rows += [x, y]
    got = {x.doc_id: x.group_id for x in near_dedup.groups(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)).collect()}
    assert all(g in (i, i - i % 2) for i, g in got.items())
    found = defaultdict(list)
    for n, similarity, kind, i in cells:
        similar = near_dedup.banded_cost(words(rows[i]), words(rows[i + 1]), 600) <= 0.2 * max(len(words(rows[i])), len(words(rows[i + 1]))) + 1e-9
        if similar:
            found[n, similarity].append(got[i + 1] == i)
    for (n, similarity), hits in found.items():
        assert np.mean(hits) >= (1 if n <= 60 else 0.9), (n, similarity, np.mean(hits))
    assert len(found) > 30


def crowd(r):
    """Texts that share a passage, unlike but for it, some of them near copies of others; near copies of one text; short texts; texts of a few common words."""
    own = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    passage, rows, many = own(40), [], own(120)
    for i in range(40):
        place = r.randrange(60)
        mine = own(60)
        rows.append([*mine[:place], *passage, *mine[place:]])
        if i % 4 == 0:
            rows.append([*passage, *mine[:50], *own(5)])
        x = list(many)
        for _ in range(r.randrange(1, 14)):
            x[r.randrange(120)] = own(1)[0]
        rows.append(x)
        rows.append([r.choice("abcdefgh") for _ in range(r.randrange(8, 16))])
    return [" ".join(x) for x in rows]


@pytest.mark.parametrize("parameters", [{}, {"cold": 2, "short": 0}])
def test_near_dedup_of_crowds(spark, parameters):
    texts = crowd(random.Random(2))
    want = groups_by_edit_distance(texts)
    got = {x.doc_id: x.group_id for x in near_dedup.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **parameters).collect()}
    for i, t in enumerate(texts):
        if len(words(t)) > 60 or parameters.get("short") != 0:
            assert got[i] == want[i], t


def repetitive_texts():
    """Long texts that repeat a line: few edits far apart, other numbers of repeats, short texts with the line, and other lines with the same own words."""
    r = random.Random(5)
    line = [f"l{i}" for i in range(10)]
    other = [f"o{i}" for i in range(10)]
    own = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    edited = line * 60
    edited[100], edited[500] = "x", "y"
    said = own(20)
    rows = [line * 60, edited, line * 3, line * 4, line * 50 + own(5), line * 59 + own(30), line * 30, [*line * 40, *own(150)], [*line * 40, *own(160)], [*said, *line * 12], [*said, *other * 12], line * 50 + own(90), line * 50 + own(100)]
    return [" ".join(x) for x in rows]


def groups_by_edit_distance(texts):
    """The smallest place of each text's group, if texts are linked by an edit similarity of 0.8."""
    w = [words(t) for t in texts]
    root = list(range(len(w)))
    for b in range(len(w)):
        for a in range(b):
            if distance(w[a], w[b]) <= 0.2 * max(len(w[a]), len(w[b])) + 1e-9:
                root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
    return root


def test_near_dedup_of_repetitive_texts(spark):
    texts = repetitive_texts()
    want = groups_by_edit_distance(texts)
    assert len(set(want)) > 5 and want[1] == 0 and want[2] != 0
    got = {x.doc_id: x.group_id for x in near_dedup.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(want))


def joins(spark, run):
    """(description, rows out) of each join that ``run()`` executes."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    listed, out = store.executionsList(before, 1000), []
    for i in range(listed.size()):
        k = listed.apply(i).executionId()
        values, nodes = store.executionMetrics(k), store.planGraph(k).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            if "Join" in node.name():
                made = (node.metrics().apply(j) for j in range(node.metrics().size()))
                rows = sum(int(values.apply(m.accumulatorId()).replace(",", "")) for m in made if m.name() == "number of output rows" and values.contains(m.accumulatorId()))
                out.append((re.sub(r"#\d+L?", "", node.desc()), rows))
    return out


def test_near_dedup_joins(spark):
    """Joins by document make a row per document, not one per word of it, and no salted table goes through the driver."""
    docs = spark.createDataFrame(list(enumerate(crowd(random.Random(2)))), "doc_id long, text string")
    found = joins(spark, lambda: near_dedup.groups(docs, cold=2))
    own = [rows for what, rows in found if re.search(r"Join \[id\], \[id\], Inner", what)]
    assert own and max(own) > 0 and max(own) <= docs.count()
    split = [what for what, _ in found if "_salt" in what]
    assert split and not [what for what in split if "Broadcast" in what]


@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), max_size=40))
@settings(max_examples=200, deadline=None)
def test_bounds_before_alignment(x, y):
    w = Words(pa.array([" ".join(f"w{i}" for i in t) for t in (x, y)]))
    a, b = near_dedup.marked(w)
    assert max(np.bitwise_count(a & ~b).sum(), np.bitwise_count(b & ~a).sum()) <= distance(x, y)
    rare_x, rare_y = near_dedup.prefixes(w, np.random.default_rng(0).integers(0, 5, near_dedup.CELLS), 0.8)
    if x and y and distance(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9:
        assert set(rare_x.tolist()) & set(rare_y.tolist())


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 103), (103, 101), (7, 7)]
    got = dict(map(tuple, near_dedup.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100, 103: 100}


# ---------------------------------------------------------------- 2

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def ok(kind, s):
        d = re.sub(r"[^0-9]", "", s)
        if kind == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        if kind == "card":
            return 14 <= len(d) <= 19 and sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 10 <= len(d) <= 15

    found = [(m.start(), k, m.end(), kind) for k, kind in enumerate(BASE) for m in re.finditer(BASE[kind], text) if ok(kind, m[0])]
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


@given(st.text("a1@.-+ (4é", max_size=60))
@settings(max_examples=500, deadline=None)
def test_pii_spans(text):
    assert [(a, b, k) for a, b, k, _ in pii.spans(text) if k in pii.BASE_KINDS] == plain_spans(text)


def test_pii_query(spark):
    texts = documents(spark)
    for r in pii.op2_pii(spark, SF).collect():
        base = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for *_, k in base) for x in BASE]


def test_pii_added_kinds_and_redaction(spark, docs):
    text = "IBAN DE89 3704 0044 0532 0130 00, not DE88 3704 0044 0532 0130 00; SSN 123-45-6789"
    assert [k for _, _, k, _ in pii.spans(text)] == ["iban", "national_id"]
    assert pii.spans("the code 123-45-6789 of it") == []
    assert pii.redact_text("write jo@ex.com!") == "write [email]!"
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.count() == 12
    assert clean.where("doc_id = 8").first().text == "mail me: [email] or [phone]"
    assert pii.find(docs).count() == 12 and pii.find(docs.limit(0)).count() == 0
    assert len(list(pii.emails("a" * 200_000 + " b@c.d"))) == 1


# ---------------------------------------------------------------- 3


def library_ids(texts):
    """By the library alone, freshly made."""
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(token_files.tokenizer_path()).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


def encoder_ids(texts):
    ids, at = token_files.Encoder(token_files.tokenizer_path()).encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]


def test_encoder_equals_the_library():
    r = random.Random(5)
    texts = ["".join(r.choice("ab1 \n\t-é'½\u2003s\u3000\x00ÿ\xad") for _ in range(r.randrange(30))) for _ in range(5000)]
    texts += ["".join(r.choice(["'", "'", " ", "s", "t", "re", "ve", "m", "ll", "d", "l", "v", "S", "x", "-", "1", "\n"]) for _ in range(r.randrange(12))) for _ in range(5000)]
    texts += ["don't we'll", "<|endoftext|> x", "日本 1", "", None, "'", "x'", "x's", "x'l", "x'", "s"]
    for text, got, want in zip(texts, encoder_ids(texts), library_ids(texts), strict=True):
        assert got == want, text


def test_encoder_knows_all_characters():
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    texts = ["\n".join(f"x{chr(c)}1 {chr(c)}{chr(c)}" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    for i in range(0, len(texts), 4000):
        assert encoder_ids(texts[i : i + 4000]) == library_ids(texts[i : i + 4000])


@given(st.lists(st.lists(st.integers(0, 100_000), min_size=1, max_size=9), max_size=6), st.booleans())
def test_planes(rows, small):
    rows = [[x % 50_000 for x in r] for r in rows] if small else rows
    n = np.array([len(r) for r in rows], np.int64)
    flat = np.array([x for r in rows for x in r], np.int32)
    if rows:
        assert token_files.unplanes(token_files.planes(flat, n), n).tolist() == flat.tolist()


@given(st.lists(st.lists(st.integers(1, 400).map(lambda x: x * 0x0123456789ABCDEF % 2**64 | 1), max_size=60), max_size=8))
def test_hash_table(batches):
    table_, known = token_files.HashTable(), {}
    for batch in batches:
        new = [h for h in dict.fromkeys(batch) if h not in known]
        table_.add(np.array(new, np.uint64))
        known |= {h: len(known) + i for i, h in enumerate(new)}
        wanted = [*known, 3]
        assert table_.find(np.array(wanted, np.uint64)).tolist() == [known.get(h, -1) for h in wanted]


def test_hash_table_grows():
    h = np.random.default_rng(0).integers(1, 2**63, 300_000).astype(np.uint64)
    h = np.unique(h)
    table_ = token_files.HashTable()
    for part in np.array_split(h, 7):
        table_.add(part)
    assert np.array_equal(table_.find(h), np.arange(len(h)))


def test_encoder_finds_added_tokens():
    texts = ["a <|endoftext|> x", "<|endoftext|>", "plain words", None, "it's <|endoftext|><|endoftext|>", "x<|endoftext|", "  <|endoftext|>\n\n y", "é <|endoftext|>"]
    got = encoder_ids(texts)
    assert got == library_ids(texts) and 50256 in got[0]
    assert encoder_ids(texts[:1]) == got[:1] and encoder_ids([]) == []


@given(st.lists(st.integers(0, 40), min_size=1, max_size=300), st.integers(6, 12), st.integers(1, 50))
@settings(max_examples=100, deadline=None)
def test_huffman_round_trip(ids, limit, block):
    ids = np.array(ids)
    lengths = token_files.code_lengths(np.bincount(ids), limit)
    assert lengths.max() <= limit and (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1
    data, _, inside = token_files.encode_ids(ids, np.array([len(ids)]), token_files.canonical(lengths)[0], lengths, block)
    n = np.minimum(block, len(ids) - np.arange(len(inside)) * block)
    assert np.array_equal(token_files.decode_blocks(data, inside, n, lengths), ids)


def test_pack():
    assert pack(np.array([1, 2, 3]), np.array([1, 2, 2]), np.array([0, 1, 40]), 6).tolist() == [0b11000000, 0, 0, 0, 0, 0b11000000]


def test_token_files(spark):
    got = sorted(token_files.op3_token_files(spark, SF).collect())
    texts = sorted(documents(spark).items())
    start = 0
    for r, (i, _), ids in zip(got, texts, library_ids([t for _, t in texts]), strict=True):
        ids = np.array([*ids, 2], "<u4")
        assert tuple(r) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_awkward(spark, docs):
    docs = docs.union(docs.sparkSession.createDataFrame([(11, "it's <|endoftext|>", "a", 1, "k"), (None, "other", "a", 1, "k")], docs.schema))
    for size in (1000, 30_000_000):
        files = token_files.write_files(docs, file_tokens=size)
        rows = sorted(token_files.read_files(files).collect(), key=lambda r: r.start)
        assert size > 1000 or files.count() > 1
        order, start = [], 0
        for r in rows:
            assert r.start == start
            start += r.n_tokens
            order.append(-1 if r.doc_id is None else r.doc_id)
        assert order == sorted(order)
        texts = [(r.doc_id, r.text) for r in docs.collect()]
        want = [(i, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())) for (i, _), ids in zip(texts, library_ids([t for _, t in texts]), strict=True)]
        assert sorted(map(repr, ((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows))) == sorted(map(repr, want))
    assert token_files.read_files(token_files.write_files(docs.limit(0))).count() == 0


# ---------------------------------------------------------------- 4


def test_url_rules(spark):
    urls = ["http://a.Example.com/en/7?x", "http://com/en/", "https://b.net/de/1", "x://example.net/de/8#y", "http://c.org/es/..", "http://xcom/en/", "no url", None, "http://h", "http://example.com/en/8", ""]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(pages, url_filter.train(url_filter.rule_labels(pages))).collect()}
    assert [got[i].rule for i in range(11)] == ["example.com/en/7", "com/en/", "net/de/", "example.net/de/8", "org/es/", None, None, None, None, "com/en/", None]
    assert [got[i].verdict for i in (0, 1, 2, 3, 4)] == ["allow", "block", "block", "allow", "block"]
    assert (got[0].host, got[0].path, got[7].host, got[7].path, got[8].path) == ("a.example.com", "/en/7", "", "", "")
    assert url_filter.judge(pages.limit(0), url_filter.train(url_filter.rule_labels(pages.limit(0)))).count() == 0


def test_url_rules_say_what_the_contract_lists(spark):
    listed = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "block", "example.net/de/8": "block", "org/es/": "block"}
    assert {text: action for action, text in url_filter.RULES} == listed
    pages = spark.createDataFrame([(i, f"http://a.{text}") for i, text in enumerate(listed)], "page_id long, url string")
    got = url_filter.judge(pages, url_filter.train(url_filter.rule_labels(pages))).collect()
    assert {r.rule: r.verdict for r in got} == listed


def test_url_suffix_cells_take_the_whole_suffix():
    assert len({url_filter.cell(f"{x}news.com") for x in ("bad", "good", "world", "")}) == 4


def plain_url(url):
    """(host, path) by splitting."""
    if url is None or "://" not in url:
        return "", ""
    rest = re.sub(r"[?#].*", "", url.split("://", 1)[1], flags=re.S)
    host, slash, path = rest.partition("/")
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), slash + path


def plain_rule(host, path):
    fits = [(text, action) for action, text in url_filter.RULES if (host == (h := text.split("/")[0]) or host.endswith("." + h)) and path.startswith(text[len(h) :])]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def plain_features(url, host, path, rates):
    chars = lambda t: [t.count(c) / len(t) for c in set(t)]
    entropy = lambda t: -sum(p * np.log2(p) for p in chars(t))
    digits = lambda t: sum(c.isdigit() for c in t) / max(1, len(t))
    query = url.split("#")[0].split("?", 1)[1] if "?" in url.split("#")[0] else url.split("?", 1)[1].split("#")[0] if "?" in url else ""
    labels = host.split(".")
    rate = [rates[url_filter.cell(x)] for x in (labels[-1], ".".join(labels[-2:]))]
    return [len(url), len(host), len(path), path.count("/"), len(labels), digits(url), digits(host), host.count("-"), entropy(host) if host else 0, entropy(path) if path else 0,
            len(query.split("&")) if query else 0, len(query), url.startswith("https"), *rate]


def test_url_query(spark):
    """Host, path, rule and the rules' verdicts by plain splitting; suffix statistics by counting; the trees' verdicts by plain features and a walk down each tree."""
    pages = {r.page_id: r.url for r in table(spark, SF, "pages").collect()}
    trees, rates = url_filter.train(url_filter.rule_labels(table(spark, SF, "pages")))
    n, blocked = np.zeros(url_filter.BUCKETS), np.zeros(url_filter.BUCKETS)
    for url in pages.values():
        host, path = plain_url(url)
        if action := plain_rule(host, path)[1]:
            for x in (host.split(".")[-1], ".".join(host.split(".")[-2:])):
                n[url_filter.cell(x)] += 1
                blocked[url_filter.cell(x)] += action == "block"
    assert np.allclose(rates, (blocked + 1) / (n + 2))

    def probability(x):
        margin = trees.base
        for tree, value in trees.trees:
            leaf = 0
            for feature, cut in tree:
                leaf = leaf * 2 + int(np.float32(x[feature[leaf]]) > cut[leaf])
            margin += value[leaf]
        return 1 / (1 + np.exp(-margin))

    got = {r.page_id: r for r in url_filter.op4_url_filter(spark, SF).collect()}
    assert set(got) == set(pages)
    for i, url in pages.items():
        host, path = plain_url(url)
        rule, action = plain_rule(host, path)
        p = probability(plain_features(url or "", host, path, rates))
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule) and got[i].score == pytest.approx(p)
        assert got[i].verdict == (action or ("block" if p >= 0.5 else "allow"))


def test_url_awkward(spark):
    long = "http://" + "a." * 50_000 + "com/" + "x?" * 100_000
    rows = [(1, long), (1, long), (None, "http://com/en/"), (2, "http://com/en/"), (2, "http://com/en/"), (3, "http://org/q"), (4, None), (5, "://?#"), (6, "HTTP://X.NET/de/")]
    pages = spark.createDataFrame([(*r, "u", "s") for r in rows], "page_id long, url string, host string, label string")
    got = url_filter.judge(pages, url_filter.train(url_filter.rule_labels(pages))).collect()
    assert len(got) == len(rows)
    for (i, url), r in zip(sorted(rows, key=repr), sorted(got, key=lambda r: repr((r.page_id, {x[0]: x[1] for x in rows}[r.page_id]))), strict=True):
        assert (r.page_id, r.host, r.path) == (i, *plain_url(url)) and r.rule == plain_rule(*plain_url(url))[0]


def test_url_first_split_is_the_best():
    r = np.random.default_rng(3)
    x = r.integers(0, 6, size=(200, 3)).astype(np.float32)
    y = (x[:, 1] + r.normal(0, 1.5, 200) > 2.5).astype(float)
    feature, cut = (v[0] for v in url_filter.Trees(x, y, trees=1, depth=1).trees[0][0][0])
    p = y.mean()

    def gain(f, c):
        up = x[:, f] > c
        part = lambda m: (y[m] - p).sum() ** 2 / (m.sum() * p * (1 - p) + 1)
        return part(up) + part(~up)

    assert gain(feature, cut) == pytest.approx(max(gain(f, c) for f in range(3) for c in range(6)))


def test_url_trees_learn():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    assert ((url_filter.Trees(x[:1500], y[:1500]).predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95


# ---------------------------------------------------------------- 5


@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.integers(1, 3), min_size=1, max_size=4))
@settings(max_examples=300, deadline=None)
def test_fm_index(text, phrase):
    text = np.array([*text, 0], np.int32)
    index = decontaminate.Index(text, 3)
    low, high = index.count(np.array([phrase]))
    got = sorted(index.locate(np.arange(low[0], high[0])).tolist())
    assert got == [i for i in range(len(text) - len(phrase) + 1) if text[i : i + len(phrase)].tolist() == phrase]


def brute_hits(text, windows):
    w, hit, items = words(text), set(), set()
    for n in {len(k) for k in windows}:
        for i in range(len(w) - n + 1):
            if found := windows.get(tuple(w[i : i + n])):
                items |= found
                hit |= set(range(i, i + n))
    return len(w), len(hit), sorted(items)


def windows_of(items):
    out = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(len(w) - min(13, len(w)) + 1) if w else ():
            out[tuple(w[i : i + min(13, len(w))])].add(str(item))
    return out


def test_decontaminate(spark, docs):
    windows = windows_of([tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()])
    texts = documents(spark)
    for r in decontaminate.op5_decontaminate(spark, SF).collect():
        n, hit, items = brute_hits(texts[r.doc_id], windows)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(items), hit > 0 and 20 * hit >= n)
        assert r.items_sha256 == hashlib.sha256(",".join(items).encode()).hexdigest()
    items = spark.createDataFrame([(1, "word3 word4"), (2, "short"), (2, "short"), (3, None), (4, "..."), (5, " ".join(f"word{i}" for i in range(30)))], "item_id long, text string")
    windows = windows_of([tuple(r) for r in items.collect()])
    for most in (2_000_000, 5):
        got = decontaminate.find(docs, items, round_words=most).withColumn("n_hit", decontaminate.n_hit()).collect()
        want = [(r.doc_id, *brute_hits(r.text, windows)) for r in docs.collect()]
        assert sorted(map(repr, ((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got))) == sorted(map(repr, want))
    clashing = docs.selectExpr("*", "1 as doc", "2 as found", "3 as new", "4 as spans", "5 as n_words")
    for most in (2_000_000, 5):
        clean = decontaminate.keep_clean(clashing, items, round_words=most)
        assert clean.columns == clashing.columns and sorted(r.doc_id or 0 for r in clean.collect()) == [4, 5, 6, 7, 8, 9]
        cut = decontaminate.remove(clashing, items, round_words=most)
        assert cut.columns == clashing.columns and sorted(map(repr, cut.where("doc_id in (4, 5, 6, 7, 8, 9)").collect())) == sorted(map(repr, clashing.where("doc_id in (4, 5, 6, 7, 8, 9)").collect()))
        for r in cut.where("doc_id is null or doc_id in (1, 2, 3, 10)").collect():
            assert words(r.text) == ([] if r.doc_id == 10 else [f"word{i}" if i != 200 or r.doc_id != 2 else "other" for i in range(30, 400)])
        assert decontaminate.remove(docs.limit(0), items, round_words=most).count() == decontaminate.keep_clean(docs.limit(0), items, round_words=most).count() == 0
    assert decontaminate.keep_clean(docs, items.limit(0)).count() == docs.count() == decontaminate.remove(docs, items.limit(0)).count()


@given(st.lists(st.tuples(st.integers(0, 5), st.lists(st.integers(0, 3), max_size=9)), max_size=8), st.integers(1, 4))
@settings(max_examples=200, deadline=None)
def test_phrases(items, window):
    items = [(i, " ".join(f"w{x}" for x in t)) for i, t in items]
    want = defaultdict(set)
    for i, t in items:
        w = t.split()
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            want[tuple(w[k : k + n])].add(str(i))
    got = decontaminate.compile_phrases(items, window)
    named = {int(h): t for t in {x for _, t in items for x in t.split()} for h in Words(pa.array([t])).hashes}
    found = {tuple(named[int(got.words[x - 1])] for x in p): set(o) for table_, owners in zip(got.phrases, got.items, strict=True) for p, o in zip(table_.tolist(), owners, strict=True)}
    assert found == want


# ---------------------------------------------------------------- 6


def test_warc_round_trip(spark):
    pages = {r.page_id: r.html for r in table(spark, SF, "pages").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    got = warc.op6_warc(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        data = (pages[r.page_id] or "").encode()
        own = first[pages[r.page_id]]
        assert (r.payload_bytes, r.payload_digest) == (len(data), warc.base32(hashlib.sha1(data).digest()))
        assert (r.record_type, r.refers_to) == (("response", None) if own == r.page_id else ("revisit", own))


def test_warc_awkward(spark):
    rows = [(3, "http://A.b.com/x\ty", "dup"), (1, "http://A.b.com/x", "dup"), (2, None, None), (5, "nourl", "dup"), (None, "http://q.com", "dup"), (7, "http://q.com", ""), (1, "http://A.b.com/x", "dup")]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, key string")
    keys = pages.select(warc.key_of().alias("key"), "page_id")
    shards = warc.write(pages, block=2, shards=3)
    got = warc.lookup(shards, keys).collect()
    assert sorted((r.page_id or -1, r.record_type, r.refers_to) for r in got) == [(-1, "revisit", 1), (1, "response", None), (1, "response", None), (2, "response", None), (3, "revisit", 1), (5, "revisit", 1), (7, "revisit", 2)]
    assert warc.lookup(shards, keys.where("key = 'com,q)'"), whole_keys=True).count() == 2
    assert warc.lookup(shards, keys.select(warc.F.lit("zzz").alias("key"), "page_id")).count() == 0
    assert warc.lookup(warc.write(pages.limit(0)), keys).count() == 0
    assert [warc.page_of(warc.record_id(x)) for x in (None, 0, -5, 2**62 + 3)] == [None, 0, -5, 2**62 + 3]


# ---------------------------------------------------------------- 7


@given(st.lists(st.integers(-5, 5), max_size=25))
@settings(max_examples=300, deadline=None)
def test_segments_are_maximal(scores):
    s = np.array(scores)
    total = np.concatenate(([0], np.cumsum(s)))
    edge = np.diff(np.concatenate(([0], (s > 0).astype(int), [0])))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    got = [(int(a[x]), int(b[y])) for x, y in toxicity.segments(total[a].tolist(), total[b].tolist())]

    def plain(low, high):  # the best segment (the shortest of equal ones), then left and right of it
        best = max(((total[j] - total[i], -(j - i), -i, i, j) for i in range(low, high) for j in range(i + 1, high + 1)), default=(0,))
        return [] if best[0] <= 0 else [*plain(low, best[3]), (best[3], best[4]), *plain(best[4], high)]

    assert sum(total[j] - total[i] for i, j in got) == sum(total[j] - total[i] for i, j in plain(0, len(s)))


def test_toxicity_sums_all_segments():
    model = toxicity.Model(np.zeros(0), np.zeros(0), rate=1.0, k=1.0)
    scores = [9.0 + i / 100 for i in range(300)]
    x, _ = toxicity.evidence([[(2 * i, 2 * i + 1, s) for i, s in enumerate(scores)]], np.array([1000]), model)
    assert x[0, 2] == pytest.approx(np.log1p(sum(max(0.0, s - np.log(1000)) for s in scores)))


def test_toxicity_by_plain_loops(spark):
    """The words' log-odds, lambda, segments and scores of a small table."""
    r = random.Random(4)
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        t = [r.choice(["river", "stone", "cloud", "lamp", "green", "paper"]) for _ in range(30)]
        if toxic:
            t[10:14] = [r.choice(["vile", "vilest", "nasty"]) for _ in range(4)]
        rows.append((i, " ".join(t), int(toxic)))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = [(i, y) for i, _, y in rows] + [(None, 1), (3, 0), (5, None)]
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    counts, total = defaultdict(lambda: [0, 0]), [0, 0]
    for i, t, y in rows:
        if zlib.crc32(str(i).encode()) % 5:
            for x in t.split():
                total[y] += 1
                for key in (("4", x[:4]), ("6", x[:6]), ("all", x)):
                    counts[key][y] += 1
    share = total[1] / sum(total)

    def odds(x):
        q = share
        for key in (("4", x[:4]), ("6", x[:6]), ("all", x)):
            clean, toxic = counts[key] if key in counts else (0, 0)
            q = (toxic + toxicity.PRIOR * q) / (clean + toxic + toxicity.PRIOR)
        return np.log(q / (1 - q)) - np.log(share / (1 - share)) - toxicity.DRIFT

    def passages(s):
        best = max(((sum(s[i:j]), i - j, -i, i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0,))
        return [] if best[0] <= 0 else [*((a, b, v) for a, b, v in passages(s[: best[3]])), (best[3], best[4], best[0]), *((a + best[4], b + best[4], v) for a, b, v in passages(s[best[4] :]))]

    got = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    for i, t, y in rows[:60]:
        s = [odds(x) for x in t.split()]
        e = [model.rate * v - np.log(model.k * len(s)) for _, _, v in passages(s)]
        x = [1, min(30, max([-10, *e])), np.log1p(sum(max(0, v) for v in e))]
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-np.dot(x, model.weights))), abs=1e-4)
        assert [(p.first_word, p.end_word) for p in got[i].passages] == [(a, b) for (a, b, _), v in zip(passages(s), e, strict=True) if v >= -np.log(toxicity.SIGNIFICANT)]
        assert got[i].predicted == y
    p, s = np.array([0.6, 0.3, 0.1]), np.array([-1.0, -0.5, 1.5])
    rate = toxicity.solve_rate(p, s)
    assert rate > 0.01 and (p * np.exp(rate * s)).sum() == pytest.approx(1)


def test_toxicity_held_out(spark, docs):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    rows = [r for r in toxicity.op7_toxicity(spark, sf).collect() if r.doc_id in labels]
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.97
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, none).count() == 12 and toxicity.keep_clean(docs, none).columns == docs.columns


def test_smallest(spark):
    from pyspark.sql import functions as F

    from helixframe.llm._common import smallest

    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    want = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(500)
    assert smallest(rows, 500, "doc_id").collect() == want.collect() and smallest(rows, 30_000, "doc_id").count() == 20_000 and smallest(rows.limit(0), 5, "doc_id").count() == 0


# ---------------------------------------------------------------- 8


def test_mixing(spark, docs):
    for frame in (table(spark, SF, "documents"), docs):
        rows = mixing.allocate(frame).collect()
        size = {}
        for r in rows:
            size[r.source] = size.get(r.source, 0) + r.size
        order = sorted(size, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
        target, left, open_ = {}, 1.5 * sum(size.values()), set(order)
        while over := {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * size[s]}:
            for s in over:
                target[s] = 2 * size[s]
            left, open_ = left - sum(2 * size[s] for s in over), open_ - over
        target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        longest = max(r.size for r in rows)  # whatever the number of equal rows
        for s in order:
            own = [r for r in rows if r.source == s]
            assert all(r.source_size == size[s] and abs(r.target - target[s]) < 1e-6 and 0 <= r.taken <= 2 * r.size for r in own)
            assert abs(sum(r.taken for r in own) - target[s]) <= longest * (1 + 1e-9)
        assert len(rows) == frame.count() and sorted(map(repr, rows)) == sorted(map(repr, mixing.allocate(frame).collect()))
    clashing = docs.selectExpr("*", "1 as i", "2 as s", "3 as z", "4 as copies", "5 as size", "6 as _size", "7 as _copy", "8 as doc", "9 as source_size", "10 as col")
    mixed = mixing.mix(clashing)
    assert mixed.columns == clashing.columns and mixed.count() == mixing.mix(docs).count() == sum(r.copies for r in mixing.allocate(clashing).collect())
    assert mixed.select(*clashing.columns[-10:]).distinct().collect() == [tuple(range(1, 11))]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixing.allocate(docs.limit(0)).count() == 0


def test_mixing_of_equal_rows(spark, monkeypatch):
    """Sources made of equal rows come within one row of their targets; rows of one unit with different columns are shared out."""
    rows = [(1, "a b c", "x", 0)] * 1000 + [(2, "a b", "y", i % 3) for i in range(999)] + [(None, "a", "z", i) for i in range(100)] + [(i, "a b c d", "z", 0) for i in range(3, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra long")
    for most in (mixing.REPEATS, 70):
        monkeypatch.setattr(mixing, "REPEATS", most)
        got = mixing.allocate(docs).collect()
        assert len(got) == len(rows)
        for source, longest in (("x", 3), ("y", 2), ("z", 4)):
            own = [r for r in got if r.source == source]
            assert abs(sum(r.taken for r in own) - own[0].target) <= longest and all(0 <= r.copies <= 2 for r in own)
        mixed = mixing.mix(docs)
        assert mixed.columns == docs.columns
        count = lambda rows_: sorted((repr(k), n) for k, n in rows_.items())
        want, have = defaultdict(int), defaultdict(int)
        for r in got:
            want[r.doc_id, r.source] += r.copies
        for r in mixed.collect():
            have[r.doc_id, r.source] += 1
        assert count(have) == count({k: n for k, n in want.items() if n})


def test_rounding_keeps_expectations(spark):
    rows = [((i, "s", 1 + i % 7), float(1 + i % 7), 0.3, 300) for i in range(300)]
    units = spark.createDataFrame(rows, "key struct<doc_id:long,source:string,size:long>, a double, p double, n_source long")
    up = [r.key.size for r in mixing.rounded(units, 300)[0].where("up").collect()]
    assert abs(sum(up) - 0.3 * sum(a for _, a, *_ in rows)) <= 7


# ---------------------------------------------------------------- 9


@given(st.binary(min_size=0, max_size=3 * media.FRAME))
@settings(max_examples=30, deadline=None)
def test_frames_round_trip(data):
    x = np.frombuffer(data.ljust(3 * media.FRAME, b"\xff"), np.uint8).reshape(3, -1)
    film = media.avi(media.encode_frames(x), len(data))
    starts, ends, n, micro = media.parse_avi(film)
    assert n == len(data) and micro == 40_000
    assert np.array_equal(media.decode_frames(np.frombuffer(film, np.uint8), starts, ends), x)


def baseline_jpeg(planes, restart=0, own_tables=False):
    """A baseline frame of a grey plane, or of luma (twice the size) and two chroma planes, all divisible by 8; steps of 1."""
    waves = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for u in range(8)] for x in range(8)])
    codes = {}
    for key, (bits, values) in media.STANDARD.items():
        code = place = 0
        for n, many in enumerate(bits, 1):
            for _ in range(many):
                codes[key, values[place]] = f"{code:0{n}b}"
                code, place = code + 1, place + 1
            code *= 2
    zigzag, r, c, up = [], 0, 0, True
    for _ in range(64):
        zigzag.append((r, c))
        if up:
            r, c, up = (r, c + 1, False) if r == 0 and c < 7 else (r + 1, c, False) if c == 7 else (r - 1, c + 1, True)
        else:
            r, c, up = (r + 1, c, True) if c == 0 and r < 7 else (r, c + 1, True) if r == 7 else (r + 1, c - 1, False)

    def number(v):
        n = abs(v).bit_length()
        return n, f"{v if v > 0 else v + (1 << n) - 1:0{n}b}" if n else ""

    def block(plane, y, x, k, before):
        f = np.rint(waves.T @ (plane[y : y + 8, x : x + 8].astype(float) - 128) @ waves).astype(int)
        z = [int(f[p]) for p in zigzag]
        n, extra = number(z[0] - before)
        out, run = codes[(0, k), n] + extra, 0
        for i in range(1, 64):
            if not any(z[i:]):
                out += codes[(1, k), 0]
                break
            if z[i] == 0:
                run += 1
                continue
            while run > 15:
                out, run = out + codes[(1, k), 0xF0], run - 16
            n, extra = number(z[i])
            out, run = out + codes[(1, k), run << 4 | n] + extra, 0
        return out, z[0]

    colour = len(planes) > 1
    step = 16 if colour else 8
    data, bits, before, units, count = b"", "", [0, 0, 0], 0, 0

    def flush(text):
        text += "1" * (-len(text) % 8)
        return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00")

    for y in range(0, planes[0].shape[0], step):
        for x in range(0, planes[0].shape[1], step):
            if restart and units and units % restart == 0:
                data, bits, before, count = data + flush(bits) + bytes([255, 0xD0 + count % 8]), "", [0, 0, 0], count + 1
            units += 1
            todo = [(0, y + dy, x + dx) for dy in range(0, step, 8) for dx in range(0, step, 8)] + ([(1, y // 2, x // 2), (2, y // 2, x // 2)] if colour else [])
            for k, yy, xx in todo:
                text, before[k] = block(planes[k], yy, xx, min(k, 1), before[k])
                bits += text
    data += flush(bits)
    segment = lambda m, body: bytes([255, m]) + (len(body) + 2).to_bytes(2, "big") + body
    parts = [(1, 0x22 if colour else 0x11, 0), *([(2, 0x11, 0), (3, 0x11, 0)] if colour else [])]
    head = b"\xff\xd8" + segment(0xDB, b"\0" + bytes([1] * 64)) + segment(0xC0, b"\x08" + planes[0].shape[0].to_bytes(2, "big") + planes[0].shape[1].to_bytes(2, "big") + bytes([len(parts)]) + b"".join(map(bytes, parts)))
    if own_tables:
        head += b"".join(segment(0xC4, bytes([kind << 4 | n]) + b + v) for (kind, n), (b, v) in media.STANDARD.items())
    head += segment(0xDD, restart.to_bytes(2, "big")) if restart else b""
    return head + segment(0xDA, bytes([len(parts)]) + b"".join(bytes([p[0], 0x11 if p[0] > 1 else 0]) for p in parts) + b"\0\x3f\0") + data + b"\xff\xd9"


@pytest.mark.parametrize("colour", [False, True])
@pytest.mark.parametrize("restart", [0, 2])
def test_baseline_frames(colour, restart):
    r = np.random.default_rng(1)
    y = (128 + 100 * np.sin(np.arange(32)[:, None] / 5) * np.cos(np.arange(48) / 7) + r.normal(0, 8, (32, 48))).clip(0, 255).astype(np.uint8)
    frame = baseline_jpeg([y, *([r.integers(90, 160, (16, 24)).astype(np.uint8)] * 2 if colour else [])], restart, own_tables=bool(restart))
    data = np.frombuffer(b"junk" + frame, np.uint8)
    got = media.decode_frames(data, np.array([4]), np.array([len(data)]))[0].reshape(32, 48)
    assert abs(got.astype(int) - y).max() <= 2
    assert media.decode_frames(data, np.array([4]), np.array([len(data) // 2]))[0] is None


def test_media_of_other_programs(spark):
    """Baseline and lossless frames in one film, damaged frames, frames of another process, foreign and broken files, nulls."""
    dark, light = (np.full((32, 32), v, np.uint8) for v in (20, 220))
    frames = [baseline_jpeg([dark])] * 4 + [baseline_jpeg([light])] * 4
    lossless = media.encode_frames(np.full((2, media.FRAME), 7, np.uint8))
    torn = [frames[0], b"\xff\xd8junk", frames[1][:60], lossless[0], lossless[1][:-8] + b"\0" * 8, b"\xff\xd8\xff\xc2\x00\x0b" + b"\0" * 40, b""]
    whole = media.avi([*frames], 5)
    rows = [(1, whole), (2, media.avi(torn, 1)), (3, b"no film"), (4, None), (5, whole[: len(whole) // 2]), (6, b""), (7, media.avi(lossless, 0)), (None, whole)]
    got = {r.doc_id: r for r in media.read(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert [(c.first_frame, c.end_frame, c.start_ms, c.end_ms) for c in got[1].clips] == [(0, 4, 0.0, 160.0), (4, 8, 160.0, 320.0)]
    assert got[1].payload_bytes == 8 * 1024 and got[1].bad_frames == 0 and got[1].clips == got[None].clips
    assert (got[2].bad_frames, got[2].payload_bytes) == (5, 1024 + media.FRAME)
    assert [(got[i].bad_frames, got[i].payload_bytes, got[i].clips) for i in (3, 4, 5, 6)] == [(1, 0, []), (0, 0, []), (1, 0, []), (0, 0, [])]
    assert got[7].payload_bytes == 2 * media.FRAME


def test_media(spark, docs):
    texts = documents(spark)
    for r in media.op9_media(spark, SF).collect():
        data = (texts[r.doc_id] or "").encode()
        padded = data.ljust(max(1, -(-len(data) // 576)) * 576, b"\xff")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
    film = media.encode(docs)
    assert media.read(film).where("doc_id in (4, 5)").select("media_sha256", "feature").distinct().count() == 1
    assert media.clips(film).groupBy("doc_id").count().count() == 11 and media.read(film.limit(0)).count() == 0
    flat = np.concatenate([np.full((5, media.FRAME), 10, np.uint8), np.full((5, media.FRAME), 200, np.uint8)])
    assert media.cuts(flat) == [5]


# ---------------------------------------------------------------- 10


def test_quality_gradient():
    r = np.random.default_rng(2)
    d, n, top = 5, 12, 3
    cells, rows, values = r.integers(0, d, 40), np.sort(r.integers(0, n, 40)), r.normal(size=40)
    grades = r.integers(0, top + 1, n)
    p = np.concatenate((r.normal(size=d), [-0.5], r.normal(size=top - 1) * 0.3))
    value, slope = quality.loss(p, d, cells, values, rows, grades, 1e-2)
    theta = [p[d] + sum(np.exp(p[d + 1 : d + 1 + k])) for k in range(top)]
    plain = 0.0
    for i in range(n):
        margin = sum(v * p[c] for c, v, row in zip(cells, values, rows, strict=True) if row == i)
        tail = [1.0, *(1 / (1 + np.exp(t - margin)) for t in theta), 0.0]
        plain -= np.log(tail[grades[i]] - tail[grades[i] + 1]) / n
    assert value == pytest.approx(plain + 0.005 * (p[:d] ** 2).sum())
    for k in range(len(p)):
        step = np.eye(len(p))[k] * 1e-6
        numeric = (quality.loss(p + step, d, cells, values, rows, grades, 1e-2)[0] - quality.loss(p - step, d, cells, values, rows, grades, 1e-2)[0]) / 2e-6
        assert slope[k] == pytest.approx(numeric, abs=1e-6)


def test_quality_ratings(spark, docs):
    """Several ratings count with the lowest, null ones not at all; few cells make a smaller sample."""
    ratings = spark.createDataFrame([(1, 2), (1, 0), (2, None), (3, 1), (6, 2), (7, 2), (None, 0), (9, 1), (10, 2)], "doc_id long, grade int")
    model = quality.train(docs, ratings)
    assert np.diff(model.thresholds).min() > 0 and quality.score(docs, model).count() == 12
    assert not quality.train(docs, ratings, most_cells=0).weights.any()


def test_quality_held_out(spark, docs):
    sf = "/root/testdata/sf0.1"
    grade = {r.doc_id: r.grade for r in quality.grades(table(spark, sf, "labels")).collect()}
    rows = [r for r in quality.op10_quality(spark, sf).collect() if r.doc_id in grade and r.held_out]
    assert np.mean([r.keep == (grade[r.doc_id] > 0) for r in rows]) > 0.97
    assert all(1 >= r.p_over_0 >= r.p_over_1 >= 0 for r in rows)
    none = quality.train(docs, spark.createDataFrame([], "doc_id long, grade int"))
    labels = spark.createDataFrame([(1, None, 1), (2, 0, 1), (3, 1, 1), (4, 1, 0), (5, 1, None)], "doc_id long, quality int, toxic int")
    assert [r.grade for r in quality.grades(labels).orderBy("doc_id").collect()] == [None, 0, 1, 2, 2]
    assert quality.score(docs, none).count() == 12 and quality.select(docs, none).columns == docs.columns


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    texts = documents(spark)
    clean = corpus_pipeline.toxicity_stage(spark, docs, SF)
    assert clean.columns == docs.columns
    single = corpus_pipeline.near_dedup_stage(spark, clean, SF)
    groups = near_dedup.groups(clean).where("kept").count()
    assert single.count() == groups
    free = corpus_pipeline.decontamination_stage(spark, single, SF)
    windows = windows_of([tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()])
    want = []
    for r in single.collect():
        if not brute_hits(texts[r.doc_id], windows)[1]:
            want.append(r.doc_id)
    assert sorted(r.doc_id for r in free.collect()) == sorted(want)
    copies = {r.doc_id: r.copies for r in mixing.allocate(free).collect()}
    mixed = corpus_pipeline.mixing_stage(spark, free, SF)
    got = defaultdict(int)
    for r in mixed.collect():
        got[r.doc_id] += 1
    assert dict(got) == {i: c for i, c in copies.items() if c}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len(rows) == sum(copies.values()) and {r.doc_id for r in rows} == set(got)


def test_near_dedup_stage_on_repetitive_texts(spark):
    texts = repetitive_texts()
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, SF).collect()) == sorted(set(groups_by_edit_distance(texts)))


def test_pipeline_gathers_no_row_objects(spark, monkeypatch):
    """What the stages gather comes as Arrow columns: as Python rows, toxicity's 786,432 counts alone would fill the driver."""
    monkeypatch.setattr(type(spark.range(0)), "toPandas", lambda self: pytest.fail("toPandas"))
    docs = table(spark, SF, "documents").limit(60)
    assert corpus_pipeline.toxicity_stage(spark, docs, SF).count() <= 60
    assert corpus_pipeline.token_stage(spark, docs, SF).count() == 60


def test_queries_equal_their_sql(spark):
    import duckdb

    from helixframe.llm import queries

    db = duckdb.connect()
    for name in ("documents", "pages", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        want = db.execute(sql)
        columns = sorted(d[0] for d in want.description)
        got = queries.QUERIES[name](spark, SF)
        assert sorted(got.columns) == columns
        names = [d[0] for d in want.description]
        assert sorted(repr([r[c] for c in columns]) for r in got.collect()) == sorted(repr([dict(zip(names, r, strict=True))[c] for c in columns]) for r in want.fetchall())


@pytest.mark.parametrize("name", ["op1_", "op2_", "op3_", "op4_", "op5_", "op6_", "op7_", "op8_", "op9_", "op10_", "pipeline"])
def test_registered(name):
    import __spark_entry__

    assert any(k.startswith(name) for k in __spark_entry__.queries())
