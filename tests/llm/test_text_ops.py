"""Word pieces, piece lattice, tokens, shard files, packing and page text against brute force and on odd rows."""

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import html_text, packing, piece_lattice, repair_store, tokens, wordpiece

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))

ODD = [(1, "Hello  world, it's.\nNew line "), (2, ""), (3, None), (4, "\U0001f600 日本 é<|endoftext|>"), (5, "   "), (None, "null id"), (1, "Hello  world, it's.\nNew line "), (6, "ab " * 30000)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash with the operators' own."""
    rows = [(i, t, "x", "y", 0, b"z") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, label string, pos string, length int, ids binary")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pieces_of_text_encode_as_the_whole(path):
    e, r = tokens.encoder(path), random.Random(3)
    parts = list("ab'sT .,\n\t  é́ \x1cΣσςİIẞ٣中\U0001f600_ \x01!") + ["<|endoftext|>", "  ", "'re", "\r\n", " \n", "\x00", "​", "\x85", "word", "Word."]
    for _ in range(6000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(0, 14)))
        assert e.encode(t) == e.direct(t), repr(t)


def greedy(word, vocab, longest):
    s, n, i = (*word, wordpiece.END), 0, 0
    while i < len(s) and s[i:] != (wordpiece.END,):
        j = next((j for j in range(min(len(s), i + longest), i, -1) if s[i:j] in vocab), None)
        if j is None:
            return 1
        n, i = n + 1, j
    return n


def test_automaton_equals_greedy_matching():
    r = random.Random(2)
    for _ in range(1500):
        vocab = {tuple(r.choice(b"abc") for _ in range(r.randrange(1, 5))) + ((wordpiece.END,) if r.random() < 0.4 else ()) for _ in range(r.randrange(1, 9))}
        a = wordpiece.Automaton(list(vocab))
        for _ in range(8):
            w = bytes(r.choice(b"abc") for _ in range(r.randrange(1, 9)))
            assert a.count(w) == greedy(w, vocab, 9), (vocab, w)


def test_word_piece_counts(odd, empty):
    vocab = wordpiece.vocabulary(WORD)
    known, longest = set(vocab), max(map(len, vocab))
    got = Counter((r.doc_id, r.n_tokens) for r in wordpiece.count_tokens(odd, WORD).collect())
    words = lambda t: re.findall(r"[^\W\d_]+|\d|[^\w\s]+|_+", (t or "").lower())
    assert got == Counter((i, sum(greedy(w.encode(), known, longest) for w in words(t))) for i, t in ODD)
    assert wordpiece.count_tokens(empty, WORD).count() == 0


def largest_sum(word, table, longest, byte0, unknown):
    """The best path by plain recursion from the front: (sum, ids), ties to the longest last piece."""
    best = [(0.0, ())]
    for e in range(1, len(word) + 1):
        value, ids = float("-inf"), None
        for s in range(max(0, e - longest), e):
            if word[s:e] in table:
                i, score = table[word[s:e]]
                more = (i,)
            elif e - s == 1:
                score, more = unknown, tuple(byte0 + b for b in word[s:e].encode())
            else:
                continue
            if best[s][0] + score > value:
                value, ids = best[s][0] + score, (s, more)
        best.append((value, ids))
    out, e = [], len(word)
    while e:
        s, more = best[e][1]
        out[:0] = more
        e = s
    return out


#: Strings of 401 to 5000 characters without a space.
LONG_STRINGS = [("antiondis" * 700)[:n] for n in (401, 1023, 5000)] + ["".join(random.Random(n).choices("abcde日étionrs\U0001f600-", k=n)) for n in (257, 640, 2000)]


def test_lattice_against_dynamic_programme(spark, odd, empty):
    rows, byte0, unknown = piece_lattice.piece_table(PIECE)
    table = {r[0]: (r[1], r[2]) for r in rows}
    texts = [*ODD, *[(100 + k, "so " + x + " on") for k, x in enumerate(LONG_STRINGS)]]
    got = piece_lattice.encode(spark.createDataFrame(texts, "doc_id long, text string").unionByName(odd.select("doc_id", "text").limit(0)), PIECE).collect()
    want = Counter()
    for i, t in texts:
        ids = [x for w in re.findall("▁+[^▁]*|[^▁]+", "▁" + t.replace(" ", "▁") if t else "") for x in largest_sum(w, table, 16, byte0, unknown)]
        want[i, np.array(ids, np.uint32).tobytes(), len(ids)] += 1
    assert Counter((r.doc_id, bytes(r.ids), r.n_pieces) for r in got) == want
    assert all(r.round_trip and r.ids_crc32 == zlib.crc32(r.ids) for r in got)
    assert sorted(map(str, piece_lattice.encode(odd, PIECE).collect())) == sorted(str(r) for r in got if (r.doc_id or 0) < 100)
    assert piece_lattice.encode(empty, PIECE).count() == 0


def test_lattice_is_close_to_the_merge_order_and_decodes_as_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    own = {r.doc_id: np.frombuffer(r.ids, np.uint32).tolist() for r in piece_lattice.encode(docs, PIECE).collect()}
    theirs = {r.doc_id: library.encode(r.text) for r in docs.collect()}
    assert sum(map(len, own.values())) <= sum(map(len, theirs.values()))
    for ids in list(own.values())[:40] + list(theirs.values())[:40]:
        assert piece_lattice.decode(ids, PIECE) == library.decode(ids)


def test_exchanges_of_the_lattice_are_reused(spark, odd):
    out = piece_lattice.encode(odd, PIECE)
    out.write.format("noop").mode("overwrite").save()
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedExchange") >= 2, plan


def test_grammar_round_trip_and_random_access():
    r = np.random.default_rng(0)
    docs = [np.concatenate((r.choice([5, 6, 7, 8], r.integers(0, 400)), [0])).astype(np.uint32).tobytes() for _ in range(60)]
    data = repair_store.write_shard(docs, 10, 0)
    shard = repair_store.Shard(data)
    assert shard.all().tobytes() == b"".join(docs) and len(shard.symbols) < len(shard.all()) / 2
    assert all(shard.document(k).tobytes() == d for k, d in enumerate(docs))
    flat = shard.all()
    for _ in range(300):
        a, b = sorted(r.integers(0, len(flat) + 1, 2).tolist())
        assert shard.tokens(a, b).tolist() == flat[a:b].tolist()
    with pytest.raises(ValueError):
        shard.tokens(0, len(flat) + 1)
    # no pair of neighbours is left that occurs LEAST times, but for those at a document's end
    s = shard.symbols.tolist()
    barrier = shard.alphabet.tolist().index(0)
    left = Counter((a, b) for a, b in zip(s, s[1:]) if a != b and barrier not in (a, b))
    assert max(left.values()) < repair_store.LEAST and len(shard.left) > 10
    named = repair_store.Shard(repair_store.write_shard(docs[:3], 10, 0, [7, None, -1], 4, 99))
    assert (named.doc_ids, named.part, named.before) == ([7, None, -1], 4, 99)
    for ids in ([0], [5] * 9 + [0], [0, 0, 0]):
        seq, left, right = repair_store.compress(np.array(ids * 20, np.uint32), 10, 0, least=2)
        assert not (np.isin(left, [0]).any() or np.isin(right, [0]).any())
    with pytest.raises(ValueError):
        repair_store.Shard(data[:-1])


def test_token_files(odd, empty):
    e = tokens.encoder(BYTE)
    got = repair_store.read_token_files(repair_store.write_token_files(odd, BYTE, 0)).orderBy("start").collect()
    at = 0
    for r in got:
        ids = bytes(r.ids)
        assert r.start == at and r.n_tokens == len(ids) // 4 and r.ids_crc32 == zlib.crc32(ids)
        at += r.n_tokens
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter((i, (e.direct(t) if t else b"") + bytes(4)) for i, t in ODD)
    assert [r.doc_id for r in got] == sorted((i for i, _ in ODD), key=lambda i: -1 if i is None else i)
    assert repair_store.read_token_files(repair_store.write_token_files(empty, BYTE, 0)).count() == 0


def best_fit_decreasing(lengths, cap):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [(g, i) for i, g in enumerate(bins) if g >= n]
        if fits:
            bins[min(fits)[1]] -= n
        else:
            bins.append(cap - n)
    return len(bins)


@pytest.mark.parametrize("cap, n, seed", [(4096, 700, 1), (100, 300, 2), (1, 5, 4)])
def test_rounds_pack_about_as_best_fit_decreasing(spark, cap, n, seed):
    """In many tasks and in one: gapless sequences, each row once, few more than best-fit decreasing over single rows needs."""
    r = random.Random(seed)
    lengths = [r.randrange(1, cap + 1) if r.random() < 0.5 else r.randrange(1, max(2, cap // 6)) for _ in range(n)] + [cap] * 3
    df = spark.createDataFrame([(k, x, "s", k) for k, x in enumerate(lengths)], "doc_id long, length int, offset string, row long").repartition(5)
    for task_rows in (23, 50_000):
        rows = packing.best_fit_pack(df, cap, task_rows).collect()
        assert sorted((x.doc_id, x.length, x.row) for x in rows) == sorted((k, v, k) for k, v in enumerate(lengths))
        by = {}
        for x in rows:
            by.setdefault(x.sequence_id, []).append((x.offset, x.length))
        for parts in by.values():
            at = 0
            for off, size in sorted(parts):
                assert off == at
                at += size
            assert at <= cap
        best = best_fit_decreasing(lengths, cap)
        assert len(by) <= best + max(1, best // 50), (len(by), best)


def shapes():
    r = random.Random(7)
    near = lambda n, mean, sd: [max(1, round(r.gauss(mean, sd))) for _ in range(n)]
    return {
        "one length, three fit": [1365] * 900,
        "one length, seven fit": [520] * 2100,
        "one length, six fit": [600] * 1200,
        "about a third, and short ones": near(2000, 1300, 60) + [r.randrange(1, 200) for _ in range(500)],
        "three lengths": [2100] * 300 + [1300] * 2000 + [300] * 300,
        "uniform": [r.randrange(1, 4097) for _ in range(3000)],
        "a quarter to a half": [r.randrange(1025, 2049) for _ in range(3000)],
        "an eighth to a third": [r.randrange(500, 1500) for _ in range(3000)],
        "short": [r.randrange(1, 300) for _ in range(3000)],
    }


@pytest.mark.parametrize("name", sorted(shapes()))
def test_few_sequences_whatever_the_lengths(name):
    """Within two hundredths of best-fit decreasing, by the rounds that one task does; fast, so many shapes."""
    lengths = shapes()[name]
    gaps = {}
    placed = packing.settle([(n, k) for k, n in enumerate(lengths)], gaps, packing.classes(4096), 4096, 0)
    assert sorted((k, n) for k, n, _ in placed) == list(enumerate(lengths))
    used = Counter()
    for _, n, s in placed:
        used[s] += n
    assert max(used.values()) <= 4096 and gaps == {s: 4096 - n for s, n in used.items()}
    best = best_fit_decreasing(lengths, 4096)
    assert len(used) <= best * 1.02, (len(used), best)


@pytest.mark.parametrize("name", ["one length, three fit", "three lengths", "about a third, and short ones"])
def test_few_sequences_in_many_tasks(spark, name):
    lengths = shapes()[name]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lengths)], "doc_id long, length int")
    used = packing.best_fit_pack(df, 4096, 400).groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert sum(r[1] for r in used) == sum(lengths) and max(r[1] for r in used) <= 4096
    assert len(used) <= best_fit_decreasing(lengths, 4096) * 1.02


def test_ranks_pair_what_partitions_leave_over():
    """Runs of ranks against one stack over all rows."""
    r = random.Random(9)
    for _ in range(300):
        counts = [(p, r.randrange(0, 4), r.randrange(0, 4)) for p in range(r.randrange(1, 9))]
        runs, none = packing.match_ranks(counts)
        stack, want, alone = [], set(), set()
        for p, documents, slots in counts:
            for k in range(documents):
                if stack:
                    want.add((p, k, *stack.pop()))
                else:
                    alone.add((p, k))
            stack += [(p, j) for j in range(slots)]
        assert {(p, at + i, q, top - i) for p, at, n, q, top in runs for i in range(n)} == want
        assert {(p, at + i) for p, at, n in none for i in range(n)} == alone


def test_packing_of_documents(odd, empty):
    rows = packing.best_fit_pack(packing.tokenized_pieces(odd, WORD, 1)).collect()
    e = tokens.encoder(WORD)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == Counter((i, k, k * 4096, len(p) // 4, zlib.crc32(p)) for i, t in ODD for b in [(e.direct(t) if t else b"") + b"\1\0\0\0"] for k, p in enumerate(b[j : j + 16384] for j in range(0, len(b), 16384)))
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 4096
    assert len(by) <= -(-sum(r.length for r in rows) // 4096) + 1
    assert packing.best_fit_pack(packing.tokenized_pieces(empty, WORD, 1)).count() == 0


def test_page_text():
    v = html_text.visible_text
    assert v("<p>a<p>b") == "a\n\nb"
    assert v("<ul><li>x<ul><li>y</ul><li>z</ul>") == "- x\n  - y\n- z"
    assert v("<ol start=3><li>q<li>r</ol>") == "3. q\n4. r"
    assert v("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>") == "a   | bb\nccc | d"
    assert v("<table><tr><th colspan=2>head<tr><td>a<td>b</table>") == "head\na | b"
    assert v("<pre>1\n  2</pre>x") == "1\n  2\n\nx"
    assert v("<style>.z,#i{display:none}</style><b class='y z'>no</b><i id=i>no</i>yes &amp; &lt;b&gt;") == "yes & <b>"
    assert v("<div hidden>no</div><div style='DISPLAY : none'>no</div><script>'</p>'</script><noscript>no</noscript>a<br>b") == "a\nb"
    assert v("<details><summary>s</summary>no</details><dialog>no</dialog><title>no</title>") == "s"
    assert v("a </p> b <!-- c --> d <br/> <unknown>e</unknown") == "a b d\ne"
    assert v("<div>" * 3000 + "deep") == "deep"
    assert v(None) == v("") == ""
    # spans of rows and columns, numbers of items
    assert v("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>") == "a | b\n  | c"
    assert v("<table><tr><td>x<td rowspan=0>y<tr><td>z<tr><td>q</table><table><tr><td colspan=2>long head<td>r<tr><td>1<td>2<td>3</table>") == "x | y\nz\nq\n\nlong head | r\n1 | 2     | 3"
    assert v("<ol reversed><li>a<li>b<li value=9>c<li>d</ol>") == "4. a\n3. b\n9. c\n8. d"
    assert v("<ol type=a start=26><li>x<li>y</ol><ol type=I><li>q<li value=4>r</ol>") == "z. x\naa. y\n\nI. q\nIV. r"
    # the cascade
    assert v("<style>@media print{.c{display:none}} @media screen and (max-width:600px){p{display:none}} @import 'x'; @media (min-width:10px){.d{display:none}}</style><p class=c>yes<p class=d>no") == "yes"
    assert v("<style>.x{display:none}.x{display:block}#k{display:none}b.y{display:none}.y{display:inline}</style><i class=x>1</i><i id=k style='display:inline'>2</i><b class=y>no</b><u class=y>3</u>") == "1\n23"
    assert v("<style>nav ul > li.off, [data-h='1'], a:hover, p + b {display:none!important}</style><nav><div><ul><li class=off style='display:block'>no<li>yes</ul></div></nav><a>link</a><u data-h=1>no</u>") == "- yes\n\nlink"
    assert v("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div><div hidden style='display:block'>too</div>") == "yes\ntoo"
    # form fields, drawings and formulas
    assert v("<select><option>a<option selected>b<option>c</select> <select multiple><option>d<option>e</select><textarea>\nf\n g</textarea><input value=h><input type=hidden value=no><input type=checkbox value=no>") == "b\nd\ne\nf\n gh"
    assert v("<svg><title>no</title><text>one</text><text>two</text>no</svg><math><mi>x</mi><mo>=</mo><mn>1</mn></math>") == "one\ntwo\nx=1"


def test_pages_of_any_depth():
    v = html_text.visible_text
    assert v("<table><tr><td>" * 400 + "x") == "x"
    assert v("<div>" * 210 + "<details><summary>s</summary>no<p>no</details><p>one<p>two") == "s\n\none\n\ntwo"
    assert v("<font>" * 5000 + "a<p>b<ul><li>c</ul>") == "a\n\nb\n\n- c"
    assert v("<b><i>" * 20000 + "x" + "</i></b>" * 20000 + "<p hidden>no") == "x"
    long = "".join(f"<p>paragraph {k}" for k in range(20000))
    assert v(long) == "\n\n".join(f"paragraph {k}" for k in range(20000))


def test_cells_keep_their_blocks():
    v = html_text.visible_text
    assert v("<table><tr><td><p>a</p><p>b</p><ul><li>x<li>y</ul></td><td>r</td></table>") == "a   | r\n    |\nb   |\n    |\n- x |\n- y |"
    assert v("<table><tr><td>1<td><table><tr><td>2<td>3<tr><td>44<td>5</table><td>z<tr><td>end</table>") == "1   | 2  | 3 | z\n    | 44 | 5 |\nend"
    assert v("<table><tr><td>k<td>one<br>two<tr><td>long<td>q</table>") == "k    | one\n     | two\nlong | q"
    assert v("<table><tr><td><ol><li>a<li>b</ol></table>") == "1. a\n2. b"
    assert v("<ul><li><table><tr><td>a<td>b<br>c</table></ul>") == "- a | b\n    | c"
    # a long line runs over its column; a wide table is no grid
    long = "w" * 81
    assert v(f"<table><tr><td>{long}<td>r<tr><td>a<td>b</table>") == f"{long} | r\na | b"
    wide = "<td>c" * 200
    assert v(f"<table><tr>{wide}<tr><td>x<td>y<tr><td>p<br>q<td>z</table>") == " | ".join("c" * 200) + "\nx | y\np\nq\nz"
    deep = "<table><tr><td>a<td>" * 12
    assert re.findall("[a-z]", v(deep + "b<br>c")) == [*"a" * 12, "b", "c"]


def test_work_and_output_follow_the_page():
    """Pages whose output or time grew with the square of their size; each in seconds, output within a fixed multiple."""
    pages = [
        "<table><tr><td>" + "ten words " * 5000 + "</td></tr>" + "<tr><td>a</td><td>b</td></tr>" * 2000 + "</table>",
        "<style>div div div{color:red;display:block} p > b i{display:none}</style>" + "<div>" * 100_000 + "x",
        "<table><tr>" + "<td>a" * 20_000 + "<tr><td>" + "x<br>" * 20_000 + "</table>",
        "<table><tr>" + "<td colspan=1000 rowspan=0>a" * 300 + "<tr><td>b" * 3000 + "</table>",
        "<ul><li>x" * 30_000,
        "<blockquote>x" * 30_000,
        "<table><tr><td>x<td>" * 5000 + "y<br>" * 5000,
        "<b>word </b>" * 100_000,
        "<p><b>" * 30_000 + "x",
    ]
    for page in pages:
        start = time.process_time()
        text = html_text.visible_text(page)
        assert time.process_time() - start < 20 and len(text) < 40 * len(page), (page[:60], time.process_time() - start, len(text) / len(page))
        assert text


def test_selectors_of_random_trees():
    """Display by compounds, descendants and children against a plain search over all ancestors."""
    r = random.Random(11)
    kinds = ["div", "span", "b", ".x", ".y", "#i", "div.x", "*", "[q]"]

    def fits(node, c):
        tag, attrs = node
        return {"*": True, ".x": "x" in attrs["class"], ".y": "y" in attrs["class"], "#i": attrs["id"] == "i", "[q]": attrs["q"], "div.x": tag == "div" and "x" in attrs["class"]}.get(c, tag == c)

    def ends(path, parts):
        if not fits(path[-1], parts[-1]):
            return False
        if len(parts) == 1:
            return True
        above = range(len(path) - 1, 0, -1) if parts[-2] == " " else [len(path) - 1] if len(path) > 1 else []
        return any(ends(path[:k], parts[:-2]) for k in above)

    for _ in range(250):
        rules = []
        for _ in range(r.randrange(1, 5)):
            parts = [r.choice(kinds)]
            for _ in range(r.randrange(0, 4)):
                parts += [r.choice([" ", ">"]), r.choice(kinds)]
            rules.append(parts)
        words = []

        def tree(path, shown):
            out = ""
            for _ in range(r.randrange(0, 4) if len(path) < 7 else 0):
                node = (r.choice(["div", "span", "b"]), {"class": r.choice(["", "x", "y", "x y"]), "id": r.choice(["", "i"]), "q": r.random() < 0.3})
                now = shown and not any(ends([*path, node], p) for p in rules)
                words.append((w := f"w{len(words)}", now))
                out += f"<{node[0]} class='{node[1]['class']}' id='{node[1]['id']}'{' q' if node[1]['q'] else ''}> {w} {tree([*path, node], now)}</{node[0]}>"
            return out

        root = ("html", {"class": "", "id": "", "q": False})
        rules = [p for p in rules if not ends([root], p)]
        page = "<style>" + "".join(" ".join(p).replace("   ", " ") + "{display:none}" for p in rules) + "</style>" + tree([root], True)
        assert sorted(re.findall(r"w\d+", html_text.visible_text(page).replace("<style>", ""))) == sorted(w for w, now in words if now), page


def test_visible_words_of_random_trees():
    """Words of random trees against a plain recursive walk that only knows what is hidden."""
    r = random.Random(7)

    def tree(depth, shown, words):
        out = ""
        for _ in range(r.randrange(0, 4)):
            kind = r.choice(["word", "div", "b", "p-less", "none", "vis", "script", "table"])
            if kind == "word" or depth > 5:
                words.append((w := f"w{len(words)}", shown))
                out += f" {w} "
            elif kind == "none":
                out += f"<div style='color:red;display:none'>{tree(depth + 1, False, words) if shown is not None else ''}</div>".replace("visibility:visible", "color:blue")
            elif kind == "vis":
                out += f"<span style='visibility:visible'>{tree(depth + 1, shown, words)}</span>"
            elif kind == "script":
                out += "<script>if (a<b) { '</div>' }</script>"
            elif kind == "table":
                out += f"<table><tr><td>{tree(depth + 1, shown, words)}</td><td rowspan=2>{tree(depth + 1, shown, words)}</td></tr><tr><td>{tree(depth + 1, shown, words)}</td></tr></table>"
            else:
                out += f"<{kind[:3]}>{tree(depth + 1, shown, words)}</{kind[:3]}>" if kind != "p-less" else f"<section>{tree(depth + 1, shown, words)}</section>"
        return out

    for _ in range(300):
        words: list = []
        page = tree(0, True, words)
        assert sorted(re.findall(r"w\d+", html_text.visible_text(page))) == sorted(w for w, shown in words if shown), page


def test_pages(spark):
    pages = spark.createDataFrame([(1, "<p>x", "u"), (1, "<p>x", "u"), (2, None, "v"), (None, "", "w")], "page_id long, html string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_lines) for r in html_text.extract(pages).collect()) == [(0, "", 0), (1, "x", 1), (1, "x", 1), (2, "", 0)]
    assert html_text.extract(pages.limit(0)).count() == 0
