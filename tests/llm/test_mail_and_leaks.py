import base64
import quopri
import random

import numpy as np

from logweave.llm import leaks, mail

ITEM = "In the tale of somihapa the keeper of wexseulmra trades 383 kafell for one remarrstenma, hides the orvquenwex under a bridge."


def message(body, kind="text/plain", encoding="8bit", charset="utf-8", more=""):
    return f"From: a@b.example\nSubject: x\nContent-Type: {kind}; charset={charset}\nContent-Transfer-Encoding: {encoding}\n{more}\n{body}"


def texts(m):
    return [p.text for p in mail.text_parts(m)]


def test_encodings():
    t = "Über señor naïve"
    assert texts(message(t)) == [t]
    assert texts(message(base64.b64encode(t.encode("latin-1")).decode(), encoding="BASE64", charset="ISO-8859-1")) == [t]
    assert texts(message(quopri.encodestring(t.encode()).decode(), encoding="quoted-printable")) == [t]
    assert texts(message(base64.b64encode(t.encode()).decode()[:-3] + "!", encoding="base64"))[0].startswith("Über se")
    assert texts(message(base64.b64encode(t.encode()).decode(), encoding="base64", charset="no-such-charset")) == [t]
    assert texts(message(t, charset='"utf-8"').replace("\n", "\r\n")) == [t]
    assert texts(None) == texts("") == [] and texts("no headers at all") == [""]


def test_multipart_without_end_and_nested():
    inner = "Content-Type: multipart/alternative; boundary=in\n\n--in\nContent-Type: text/plain\n\nplain\n--in\nContent-Type: text/html\n\n<p>rich</p>\n--in--\n"
    m = 'Content-Type: multipart/mixed;\n boundary="out er"\n\npreamble\n--out er\n' + inner + "--out er\nContent-Type: image/png\nContent-Transfer-Encoding: base64\n\nAAAA\n--out er\nContent-Type: text/plain\nContent-Disposition: attachment; filename=a.txt\n\nattached"
    parts = mail.text_parts(m)
    assert [(p.text.strip(), p.attached) for p in parts] == [("plain", False), ("rich", False), ("attached", True)]
    assert mail.own_body(m).strip() == "plain"


def test_html():
    got = mail.html_text("<html><head><style>p{x}</style></head><body><p>one <b>t</b>wo&nbsp;&amp;\n three<br>four</p><!-- no --><script>x<y</script><td>a</td><td>b</td>")
    assert got.split() == ["one", "two", "&", "three", "four", "a", "b"]


def found(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    i = spark.createDataFrame(items, "item_id long, text string, suite string")
    return {(r.item_id, r.doc_id): r for r in leaks.leaked_items(d, i, **kw).collect()}


def test_leaks(spark):
    w = ITEM.split()
    docs = [
        (1, message("Hi.\n> " + "\n> ".join(w[:10]).upper()), 0), (2, message(" ".join(w[:9]) + " other " + " ".join(w[9:18])), 0), (3, message(base64.b64encode(f"<p>{' <i>'.join(w[3:15])}</p>".encode()).decode(), "text/html", "base64"), 0),
        (4, message(" ".join(w[11:]) + " and " + " ".join(w[:11])), 0), (5, None, 0), (6, "", 0), (None, message(ITEM), 0), (1, message("Hi.\n> " + "\n> ".join(w[:10]).upper()), 0), (7, message("x " * 200_000 + ITEM), 0),
    ]
    items = [(10, ITEM, "s"), (10, ITEM, "s"), (11, "too short an item", "s"), (12, None, "s"), (None, ITEM, "s"), (13, "Another. " + ITEM, "s")]
    got = found(spark, docs, items)
    assert set(got) == {(i, d) for i in (10, 13) for d in (1, 3, 4, 7)}
    assert got[10, 4].n_tiles == 2 and got[10, 4].coverage > 0.9  # reordered passages
    assert got[10, 1].longest == 10
    assert set(found(spark, docs, items, index_words=5)) == set(got)
    assert found(spark, docs, []) == {} and found(spark, [], items) == {}


def test_leaks_against_brute_force(spark):
    rnd, vocabulary = random.Random(4), "a b c d".split()
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, text(rnd.randint(5, 20)), "s") for i in range(8)]
    docs = [(d, text(rnd.randint(0, 60)) + " " + (rnd.choice(items)[1] if rnd.random() < 0.5 else ""), 0) for d in range(60)]
    k = 6
    grams = lambda t: {tuple(t.split()[i : i + k]) for i in range(len(t.split()) - k + 1)}
    want = {(i, d) for d, t, _ in docs for i, x, _ in items if grams(t) & grams(x)}
    got = found(spark, docs, items, mail=False, seed=k)
    assert set(got) == want
    # more items than are sent to the executors: the same rows by a shuffle
    assert found(spark, docs, items, mail=False, seed=k, index_words=0) == got


def test_tiles_do_not_overlap():
    rnd = random.Random(9)
    for _ in range(200):
        a, b = ([rnd.choice("xy") for _ in range(n)] for n in (30, 20))
        index = leaks.SeedIndex([(5, "z z z z"), (7, " ".join(b))], 3)
        text = np.array([index.vocabulary.get(w, 0) for w in a], dtype=np.uint64)
        spans = [(p, q, n) for o, p, q, n in index.spans(text).tolist() if index.ids[o] == 7]
        # all maximal matches, each once
        same = {(p, q) for p in range(30) for q in range(20) if a[p] == b[q]}
        runs = {(p, q): next(n for n in range(1, 31) if (p + n, q + n) not in same) for p, q in same if (p - 1, q - 1) not in same}
        assert sorted(spans) == sorted((p, q, n) for (p, q), n in runs.items() if n >= 3)
        got = leaks.tiles(spans, 30, 20, 3)
        assert bool(got) == bool(spans)
        assert [n for _, _, n in got] == sorted((n for _, _, n in got), reverse=True)
        for side in (0, 1):
            used = [i for t in got for i in range(t[side], t[side] + t[2])]
            assert len(used) == len(set(used))
        assert all(a[p : p + n] == b[q : q + n] for p, q, n in got)


def test_reordered_passages(spark):
    """Items cut into pieces of five to nine words and rearranged: found by coverage, not by a passage of ten words."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(60)), "s") for i in range(10)]
    docs = []
    for d in range(100):
        w, pieces = items[d % 10][1].split(), []
        while w:
            n = rnd.randint(5, 9)
            pieces.append(w[:n])
            w = w[n:]
        rnd.shuffle(pieces)
        docs.append((d, " ".join(" ".join([*p, word()]) for p in pieces), 0))
    docs += [(100 + d, " ".join(word() for _ in range(200)), 0) for d in range(50)]
    assert found(spark, docs, items, mail=False) == {}
    got = set(found(spark, docs, items, mail=False, seed=leaks.SHINGLE, min_coverage=leaks.COVERAGE))
    want = {(d % 10, d) for d in range(100)}
    assert got == want  # recall and precision 1


def test_wording_that_all_items_share(spark):
    shared = " ".join(f"w{i}" for i in range(300))
    items = [(i, f"{shared} own{i} " + shared, "s") for i in range(200)]
    got = found(spark, [(1, shared + " x " + shared, 0)], items, mail=False)
    assert len(got) == 200 and all(r.covered_words == 600 and r.n_tiles == 2 for r in got.values())


def test_parts_nested_to_any_depth():
    depth = 300
    m = "".join(f"Content-Type: multipart/mixed; boundary=b{i}\n\n--b{i}\n" for i in range(depth)) + "Content-Type: text/plain\n\ndeep\n" + "".join(f"--b{i}--\n" for i in reversed(range(depth)))
    assert [p.text.strip() for p in mail.text_parts(m)] == ["deep"]
    wrapped = "Content-Type: message/rfc822\n\n" * 2000 + message("inside")
    assert texts(wrapped) == ["inside"]
