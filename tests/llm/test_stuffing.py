import random

from logweave.llm import stuffing

NOUNS = "report meeting office contract figures backlog slides battery budget server team line plan note".split()
VERBS = "checked moved compared signed returned counted reviewed postponed".split()


def sentence(rnd):
    return f"The {rnd.choice(NOUNS)} {rnd.choice(VERBS)} the {rnd.choice(NOUNS)} of our {rnd.choice(NOUNS)} and we {rnd.choice(VERBS)} it with a {rnd.choice(NOUNS)}."


def prose(rnd, n):
    return "Dear Mara,\n\n" + "\n\n".join(" ".join(sentence(rnd) for _ in range(3)) for _ in range(n)) + "\n\nBest,\nJonas Weber\nWeber Group\ntel 555-100-2000\n"


def spam(rnd, kind):
    if kind == 0:
        return "\n".join(f"https://www.{rnd.choice(NOUNS)}.example/{rnd.choice(NOUNS)}-sale.html" for _ in range(40))
    if kind == 1:
        return ", ".join(rnd.choice(["cheap tent", "tent", "best tent", "buy sofa", "sofa"]) for _ in range(150))
    if kind == 2:
        return "\n".join(rnd.choice(["#tentsale", "SKU-54909", "LAMP Kettle XL/36 EUR68.99"]) for _ in range(60))
    return "\n".join(f"* Offer {rnd.choice(NOUNS)} [http://{rnd.choice(NOUNS)}.example/buy]" for _ in range(40))


def message(body):
    return f"From: a@b.example\nContent-Type: text/plain; charset=utf-8\n\n{body}"


def test_classes():
    assert stuffing.classes_of("https://x.example/a,") == bytes([stuffing.CLASSES.index("U"), stuffing.CLASSES.index(",")])
    name = lambda t: "".join(stuffing.CLASSES[c] for c in stuffing.classes_of(t))
    assert [name(t) for t in ("The", "tent,", "Friday.", "#tag", "SKU-54909", "EUR68.99", "12:30", "*", "6.", "a@b.example", "NASA", "(so")] == ["f", "w,", "C.", "H", "K", "P", "d", "b", "b", "E", "A", "qf"]


def corpus():
    rnd, rows = random.Random(6), []
    for i in range(300):
        rows.append((i, prose(rnd, rnd.randint(1, 6)), False))
    for i in range(300, 340):
        rows.append((i, spam(rnd, i % 4) + ("\n\n" + sentence(rnd) if i % 2 else ""), True))
    quoted = "\n".join("> " + x for x in spam(rnd, 3).split("\n"))
    rows.append((400, f"{sentence(rnd)}\n\nOn Monday, Ann wrote:\n{quoted}", False))
    rows.append((401, prose(rnd, 5) + "\nSee\nhttps://a.example/b\nhttps://a.example/c\n", False))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, message(t), 0.0) for d, t, _ in rows] + [(500, None, 0.0), (501, "", 0.0), (None, message("x"), 0.0), (502, message("x" * 300_000), 0.0)], "doc_id long, text string, stuffed_share double")
    got = {r.doc_id for r in stuffing.stuffed_pages(df).collect()}
    want = {d for d, _, bad in rows if bad}
    assert not want - got and not {d for d in got if d < 500} - want
    assert not got & {500, 501}
    assert stuffing.stuffed_pages(df.limit(0)).count() == 0


def test_model_is_bounded_and_repeatable(spark):
    df = spark.createDataFrame([(d, message(t)) for d, t, _ in corpus()], "doc_id long, text string")
    a, b = (stuffing.train(stuffing.sequences(df.repartition(n))) for n in (1, 7))
    assert (a.cost == b.cost).all() and len(a.cost) == stuffing.V**3


ITALIAN = "Il responsabile del magazzino ha controllato le fatture della settimana e non ha trovato errori. La riunione è stata spostata a venerdì perché il fornitore non può venire prima. Vi prego di leggere il verbale e di rispondere entro domani con le vostre domande sul contratto."
POLISH = "Kierownik magazynu sprawdził faktury z zeszłego tygodnia i nie znalazł w nich żadnych błędów. Spotkanie zostało przeniesione na piątek, ponieważ dostawca nie może przyjechać wcześniej. Proszę o przeczytanie protokołu i o odpowiedź do jutra, jeśli macie pytania do umowy."


def test_other_languages_and_strings_without_blanks(spark):
    """Languages that the corpus does not hold; keywords with nothing but commas between them; tokens and links of any length."""
    rnd = random.Random(8)
    words = [rnd.choice(["cheap", "tent", "best", "sofa", "sale", "lamp", "jacket"]) for _ in range(300)]
    rows = corpus() + [(600, ITALIAN, False), (601, POLISH, False), (602, ",".join(words), True), (603, "|".join(words), True), (604, "\n".join(f"https://a.example/{'x' * n}" for n in range(200, 400, 9)), True)]
    df = spark.createDataFrame([(d, message(t)) for d, t, _ in rows], "doc_id long, text string")
    assert {r.doc_id for r in stuffing.stuffed_pages(df).collect()} == {d for d, _, bad in rows if bad}


def test_long_tokens_have_the_classes_of_short_ones():
    for t in ("tent", "https://a.example/x", "#tag", "SKU", "a@b.example,"):
        body, tail = (t[:-1], ",") if t.endswith(",") else (t, "")
        long = body[0] + body[1:2] * 500 + body[1:] if body[0].isalpha() and "://" not in body and "@" not in body else body + "x" * 500
        assert stuffing.classes_of(long + tail) == stuffing.classes_of(t)


def test_packed_sequences():
    for body in ("", "a", "word " * 50, "x" * 3000 + " y\n> quoted:\n> z\n\nend."):
        for a, b in zip(stuffing.sequence(body), stuffing._unpacked(*stuffing._packed(body))):
            assert (a == b).all()
