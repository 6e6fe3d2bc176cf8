from __future__ import annotations

import zlib
from collections import Counter
from itertools import combinations

import numpy as np
from oracle import SF
from pyspark.sql import functions as F

from tramline.llm import html_extract, language_id, toxicity
from tramline.llm import queries as Q

MID = SF.replace("0.001", "0.01")


def test_units_join_single_letters_and_drop_signs():
    def of(*texts):
        raw = [t.encode() for t in texts]
        off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        seq, begin, row = toxicity.units(np.frombuffer(b"".join(raw), np.uint8), off)
        ends = np.append(begin, len(seq))[1:]
        return [(int(r), "".join(chr(96 + c) for c in seq[a + 1 : b])) for a, b, r in zip(begin, ends, row, strict=True)]

    assert of("ab  c-d", "", "i d i o t x!y") == [(0, "ab"), (0, "cd"), (2, "idiot"), (2, "xy")]
    assert of("", " ") == []


def test_table_equals_the_kernel_expansion():
    rng = np.random.default_rng(0)
    table = rng.normal(size=1 << (5 * toxicity.P)).astype(np.float32)
    raw = b"hello wonderful world"
    seq, begin, _ = toxicity.units(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    unit, code, weight = toxicity.features(seq, begin)
    assert np.allclose(np.bincount(unit, table[code] * weight, len(begin)), toxicity.margins(seq, begin, table), rtol=1e-4, atol=1e-4)


def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{MID}/labels.parquet")
    rows = Q.op2_toxicity(spark, MID).join(labels, "doc_id").where("held_out").collect()
    pos, neg = [r["score"] for r in rows if r["toxic"] == 1], [r["score"] for r in rows if r["toxic"] == 0]
    auc = np.mean([a > b for a in pos for b in neg])
    assert auc > 0.75 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_toxicity_tolerates_insertions(spark, docs_of):
    insults, rng = ["blorgface", "zunkhead"], np.random.default_rng(1)
    plain = lambda: " ".join("".join(rng.choice(list("aeioustnr"), 6)) for _ in range(12))
    texts = [plain() + (f" {insults[i % 2]} " if i % 3 == 0 else " ") + plain() for i in range(300)]
    texts += ["you blo-rgface", "z u n k h e a d now", "blorg*face", "quite nice", "", None]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs_of(texts), labels).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i]["predicted"] == (i % 3 == 0) for i in held]) > 0.95 and all(got[i]["held_out"] for i in held)
    assert [got[i]["predicted"] for i in range(300, 306)] == [1, 1, 1, 0, 0, 0]


def kernel_brute(a: str, b: str) -> float:
    """Subsequences of P characters with at most GAPS characters skipped, each weighing LAMBDA ** skipped, shared by two words."""
    def found(word):
        out = Counter()
        for at in combinations(range(len(word)), toxicity.P):
            skipped = at[-1] - at[0] + 1 - toxicity.P
            if skipped <= toxicity.GAPS:
                out["".join(word[i] for i in at)] += toxicity.LAMBDA**skipped
        return out

    x, y = found(a), found(b)
    return sum(x[s] * y[s] for s in x) / np.sqrt(len(a) * len(b))


def test_features_are_the_subsequence_kernel():
    words = ["blorgface", "blorxgface", "faceblorg", "gracefully", "abc", "zzzzzz"]
    raw = " ".join(words).encode()
    seq, begin, _ = toxicity.units(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    unit, code, weight = toxicity.features(seq, begin)
    phi = [Counter() for _ in words]
    for u, c, w in zip(unit, code, weight, strict=True):
        phi[u][int(c)] += float(w)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            got = sum(phi[i][c] * phi[j][c] for c in phi[i])
            assert abs(got - kernel_brute("_" + a, "_" + b)) < 1e-5  # a unit begins with a sign of its own


def test_misspelt_insults_are_caught(spark, docs_of):
    insults, rng = ["blorgface", "zunkhead"], np.random.default_rng(1)
    plain = lambda: " ".join("".join(rng.choice(list("aeioustnr"), 6)) for _ in range(12))
    texts = [plain() + (f" {insults[i % 2]} " if i % 3 == 0 else " ") + plain() for i in range(300)]
    probes = ["blorxgface", "zunkxhead", "blrgface", "b1orgface", "blorrgface", "zunkhed", "zuonkhead", "blorqface", "zunqhead", "blorgfaice"]
    clean = ["".join(rng.choice(list("aeioustnr"), 9)) for _ in range(40)] + ["blue face", "the forehead", "gorgeous"]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs_of(texts + probes + clean), labels).collect()}
    caught = [got[300 + k] for k in range(len(probes))]
    assert np.mean(caught) >= 0.8, caught
    assert sum(got[300 + len(probes) + k] for k in range(len(clean))) == 0


def test_toxicity_edges(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = docs_of([(None, "a"), (1, None), (1, "b")])
    assert all(r["score"] < 0.01 for r in toxicity.toxicity(docs, none).collect())
    assert toxicity.toxicity(docs.where("false"), none).count() == 0


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(5)
    emit, moves = rng.normal(size=(5, 3)).astype(np.float32), rng.normal(size=(3, 3))
    want = np.zeros((5, 3))
    for code in range(3**5):
        path = [(code // 3**k) % 3 for k in range(5)]
        p = np.exp(sum(emit[t, path[t]] for t in range(5)) + sum(moves[path[t], path[t + 1]] for t in range(4)))
        for t in range(5):
            want[t, path[t]] += p
    want /= want.sum(1, keepdims=True)
    got = language_id.forward_backward(emit, np.array([0]), np.array([5]), np.array([False]), moves)
    assert np.allclose(got, want, atol=1e-5)


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "lang")
    rows = Q.op10_language_id(spark, MID).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges_and_switching(spark, docs_of):
    texts = ["the cat and the dog were here"] * 20 + ["le chat et le chien sont là"] * 20 + ["123 !?", "", None, "the cat et le chien sont là et le chat"]
    lang = ["en"] * 20 + ["fr"] * 20 + [None, "xx", "xx", None]
    got = {r["doc_id"]: r for r in language_id.identify(docs_of(texts, lang=lang)).collect()}
    assert got[0]["lang_pred"] == "en" and got[25]["lang_pred"] == "fr" and got[43]["lang_pred"] == "fr"
    assert [got[i]["lang_pred"] for i in (40, 41, 42)] == ["und"] * 3 and got[40]["score"] == 0
    kept = language_id.accepted(docs_of(texts, lang=lang))
    assert {40, 41, 42}.isdisjoint(r["doc_id"] for r in kept.collect()) and "n_chars" in kept.columns
    assert all(r["lang_pred"] == "und" for r in language_id.identify(docs_of(["a b"], lang=[None])).collect())
    assert language_id.identify(docs_of(["a"]).where("false")).count() == 0


def test_expected_moves_against_enumeration():
    rng = np.random.default_rng(6)
    emit, moves = rng.normal(size=(7, 3)).astype(np.float32), rng.normal(size=(3, 3))
    want = np.zeros((3, 3))
    for begin, n in ((0, 4), (4, 3)):
        own, total = np.zeros((3, 3)), 0.0
        for code in range(3**n):
            path = [(code // 3**k) % 3 for k in range(n)]
            p = np.exp(sum(emit[begin + t, path[t]] for t in range(n)) + sum(moves[path[t], path[t + 1]] for t in range(n - 1)))
            total += p
            for t in range(n - 1):
                own[path[t], path[t + 1]] += p
        want += own / total
    got = language_id.marginals(emit, np.array([0, 4]), np.array([4, 3]), np.array([False, False]), moves)[1]
    assert np.allclose(got, want, atol=1e-4)


def test_long_sentences_keep_their_transitions(monkeypatch):
    # A sentence of 10,000 words among short ones: cut into pieces or not, the result is the same.
    rng = np.random.default_rng(7)
    new = np.zeros(10_500, bool)
    new[[0, 3, 10_003, 10_100, 10_229]] = True
    emit, moves = rng.normal(size=(len(new), 3)).astype(np.float32), rng.normal(size=(3, 3)) * 2
    got = [language_id.marginals(emit, *language_id.chains(new), moves)]
    monkeypatch.setattr(language_id, "CHAIN", 1 << 20)
    got.append(language_id.marginals(emit, *language_id.chains(new), moves))
    assert np.allclose(got[0][0], got[1][0], atol=1e-4) and np.allclose(got[0][1], got[1][1], rtol=1e-3)
    assert abs(got[0][1].sum() - (len(new) - 5)) < 1


def test_expected_moves_are_the_gradient():
    rng = np.random.default_rng(8)
    emit, moves = rng.normal(size=(9, 3)), rng.normal(size=(3, 3))

    def log_z(m):
        alpha = emit[0]
        for t in range(1, 9):
            alpha = np.logaddexp.reduce(alpha[:, None] + m, axis=0) + emit[t]
        return np.logaddexp.reduce(alpha)

    step = 1e-5
    want = [[(log_z(moves + step * (np.arange(9).reshape(3, 3) == 3 * i + j)) - log_z(moves - step * (np.arange(9).reshape(3, 3) == 3 * i + j))) / (2 * step) for j in range(3)] for i in range(3)]
    got = language_id.marginals(emit.astype(np.float32), np.array([0]), np.array([9]), np.array([False]), moves)[1]
    assert np.allclose(got, want, atol=1e-4)


def test_every_language_is_learned_from_bounded_rows(spark, docs_of):
    # 70 languages with words of their own; the rarest have the fewest rows.
    texts, lang = [], []
    for k in range(70):
        for i in range(4 if k >= 60 else 8):
            texts.append(" ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + (i + j) % 5)}{chr(110 + k % 13)}" for j in range(12)))
            lang.append(f"l{k:02}")
    docs = docs_of(texts, lang=lang)
    _, learned = language_id.training_sample(docs, 3)
    assert len(set(learned)) == 70 and max(learned.count(n) for n in set(learned)) == 3
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs).collect()}
    rare = [i for i, n in enumerate(lang) if n >= "l60"]
    assert np.mean([got[i] == lang[i] for i in rare]) > 0.9
    # Rows that all repeat one doc_id are bounded too.
    _, same = language_id.training_sample(docs_of([(1, f"t{i}") for i in range(50)], lang=["en"] * 50), 3)
    assert len(same) == 3


def test_spans_of_switched_text(spark, docs_of):
    english, french = "the cat and the dog were here", "le chat et le chien sont là"
    texts = [english] * 20 + [french] * 20 + [f"É! {english}. {french}!", "123 !?", None]
    got = {r["doc_id"]: r["spans"] for r in language_id.label_spans(docs_of(texts, lang=["en"] * 20 + ["fr"] * 20 + [None] * 3)).collect()}
    assert [(s["lang"], texts[0][s["begin"] : s["end"]], s["n_words"]) for s in got[0]] == [("en", english, 7)]
    last = [(s["lang"], texts[40][s["begin"] : s["end"]]) for s in got[40]][-2:]
    assert last[0][0] == "en" and last[0][1].endswith(english) and last[1] == ("fr", french)
    assert got[41] == got[42] == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
<nav><ul><li><a href="/">Home</a></ul></nav><header>Top</header><div class="cookie-notice">We use</div><div class="ad">Buy</div>
<article><h1>Title &amp; more</h1><p>One   two<br>three&nbsp;four<p><b>Five</b> &lt;six&gt; &#233;<div class="share">Share me</div>
<ul><li>x<li>y</ul><!-- no --><form>q<input></form><section class="comments"><p>First!</p></section></article><aside>Side</aside><footer>&copy; z</footer></body></html>"""


def test_extraction_by_structure(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", PAGE, 1), (2, None, None, 1), (3, "x", "", 1), (4, "http://q.r/", "plain &lt; text", 1), (5, "http://q.r/", "<p>a<p>b <b>c</b>d", 1)], "page_id long, url string, html string, text int")
    got = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    assert got[1]["text"] == "Title & more\nOne two three four\nFive <six> é\nx\ny" and got[1]["n_chars"] == len(got[1]["text"])
    assert (got[2]["text"], got[3]["text"], got[4]["text"], got[5]["text"]) == ("", "", "plain < text", "a\nb cd")
    assert html_extract.extract(pages.where("false")).count() == 0


def test_low_branches_go_and_copies_stay(spark):
    body = lambda i: f"<html><body><div class=zone>Same words on every page</div><div class=story><p>Story {i} is new</p><p>And {i * i} too</p></div></body></html>"
    rows = [(i, f"http://site.com/{i}", body(i)) for i in range(12)] + [(100 + i, f"http://copy.com/{i}", body(7)) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story 3 is new\nAnd 9 too" and got[105] == "Same words on every page\nStory 7 is new\nAnd 49 too"


def tree_brute(pages: dict[str, str]) -> dict[str, tuple]:
    """(pages, content, presentation) of every node of one host, from the definitions."""
    found = {html_extract.page_features(p)[0]: html_extract.blocks(p) for p in pages.values()}
    having, texts, below = {}, {}, {}
    for page, own in found.items():
        for path, text, *_ in own:
            texts.setdefault(path, {}).setdefault(text, set()).add(page)
            for k in range(1, len(path) + 1):
                having.setdefault(path[:k], set()).add(page)
                below.setdefault(path[:k], {}).setdefault(page, set()).update(path[k : k + 1])
    entropy = lambda n, m: 0.0 if m < 2 else np.log(n) / np.log(m)
    out = {}
    for node, own in having.items():
        under = [entropy(len(on), len(having[path])) for path in texts if path[: len(node)] == node for on in texts[path].values()]
        kinds = Counter(map(frozenset, below[node].values()))
        m = len(own)
        shape = 1.0 if m < 2 else -sum(c / m * np.log(c / m) for c in kinds.values()) / np.log(m)
        out[">".join(node)] = (m, 1 - np.mean(under), abs(shape))
    return out


def test_style_tree_against_definitions(spark):
    part = lambda i: "<div class=a>same</div>" * (i % 3 == 0) + f"<div class=b><p>own {i}</p><p>pair {i // 2}</p></div>" + "<i>x</i>" * (i % 2)
    pages = {f"{i}": f"<html><body>{part(i)}<ul><li>one<li>two</ul></body></html>" for i in range(7)}
    rows = [(int(i), "http://h.com/" + i, p) for i, p in pages.items()] + [(90, "http://h.com/again", pages["3"])]
    tree = html_extract.style_tree(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    got = {r["path"]: (r["pages"], r["content"], r["presentation"]) for r in tree}
    want = tree_brute(pages)
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
    assert all(abs(r["importance"] - 0.9 * r["content"] - 0.1 * r["presentation"]) < 1e-9 for r in tree)


def test_the_tree_decides_where_it_knows(spark):
    # Nothing here is named; the template goes, a class of the prior stays where it is prose of its page's own.
    prose = lambda i: f"A long paragraph number {i} about the matter of {i * 7}, which no other page of this site has word for word."
    body = lambda i: f"<body><div class=xa>Shop now {i % 2}</div><div class=header-text><p>{prose(i)}</p></div><div class=xb><p>Story {i}</p></div></body>"
    few = lambda i: f"<body><div class=xa>Shop now</div><div class=header-text><p>{prose(i)}</p></div><p>Story {i}</p></body>"
    rows = [(i, f"http://site.com/{i}", body(i)) for i in range(20)] + [(100 + i, f"http://few.com/{i}", few(i)) for i in range(3)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[4] == f"{prose(4)}\nStory 4"
    assert got[101] == "Shop now\nStory 1"  # three pages are no evidence: the prior alone decides


def test_pages_table(spark):
    rows = Q.op9_extract_html(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count() and all(r["n_chars"] > 0 for r in rows)
    assert not any("©" in r["text"] for r in rows)


def test_host(spark):
    d = spark.createDataFrame([("https://U:p@Ex.COM:80/a",), ("x",), (None,)], "u string")
    assert [r[0] for r in d.select(html_extract.host_of(F.col("u"))).collect()] == ["ex.com", "", ""]
