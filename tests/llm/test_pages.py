import random

import numpy as np

from isotwin.llm import leakage as lk
from isotwin.llm.leakage import Items, folded, leaked
from isotwin.llm.pii import Page, find_pii, fit, redact, spans

P = "doc_id bigint, text string, boxes array<struct<x0:int,y0:int,x1:int,y1:int,conf:float>>, item_id string, pii_kind string"
WORDS = "anchor barley copper dredger engine furnace granite harbour insurance justice kettle lantern mortgage notary orchard petition quarry railway surgeon tannery umbrella vaccine warehouse yeoman zinc bazaar carriage diocese election fossil".split()


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def page(doc, lines, boxes="auto"):
    if boxes == "auto":
        boxes = [(50, 20 * i, 400, 20 * i + 15, 0.9) for i in range(len(lines))]
    return (doc, "\n".join(lines), boxes, "x", "x")


def test_leaks(spark):
    rnd = random.Random(5)
    items = [(i, sentence(rnd, 40), "x") for i in range(12)] + [(90, None, "x"), (91, "", "x"), (92, "two words", "x")]
    text = items[3][1].split()
    part = " ".join(text[5:17])
    cut = part[:20] + "-\n" + part[20:30] + "\n" + part[30:]
    misread = " ".join(text[20:34]).replace("a", "4", 1).replace("i", "l").replace("m", "rn").upper()
    nine = " ".join(text[10:18])
    columns = [(50, 10 * i, 400, 9, 0.9) if i % 2 == 0 else (600, 10 * i, 900, 9, 0.9) for i in range(8)]
    halves = part.split()
    mixed = [x for a, b in zip([sentence(rnd, 4), sentence(rnd, 4), " ".join(halves[:6]), " ".join(halves[6:])], [sentence(rnd, 5) for _ in range(4)]) for x in (a, b)]
    advert = [" ".join(halves[:6]), "*********", sentence(rnd, 5), "---------", " ".join(halves[6:])]
    pages = [page(1, [sentence(rnd, 8), *cut.split("\n"), sentence(rnd, 8)]), page(2, [misread]), page(3, [sentence(rnd, 9), nine, sentence(rnd, 9)]), page(4, mixed, columns), page(5, advert), (6, None, None, "x", "x"), (7, "", [], "x", "x"), page(8, [items[3][1], items[4][1]], None), page(9, [sentence(rnd, 3000) + " " + part])]
    got = leaked(spark.createDataFrame(pages + [page(11, [sentence(rnd, 200)])], P), spark.createDataFrame(items, "item_id bigint, text string, boxes string"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 3), (2, 3), (4, 3), (5, 3), (8, 3), (8, 4), (9, 3)]


def test_an_item_on_a_third_of_all_pages(spark):
    rnd = random.Random(9)
    items = [(i, sentence(rnd, 40)) for i in range(5)]
    pages = [page(i, [sentence(rnd, 30), items[2][1] if i % 3 == 0 else sentence(rnd, 40)]) for i in range(300)]
    got = leaked(spark.createDataFrame(pages, P), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(i, 2) for i in range(0, 300, 3)]


def test_leaks_of_nothing(spark):
    pages, items = spark.createDataFrame([], P), spark.createDataFrame([(1, "a b", "x")], "item_id bigint, text string, boxes string")
    assert leaked(pages, items).count() == 0 and leaked(pages, items.where("false")).count() == 0


def test_words_and_folding():
    own = Items([(1, "The burning clay, corn-fed vessel")])
    assert own.words[0][-1] == own.sizes[0] == len(folded("The burning clay, corn-fed vessel")) and len(own.words[0]) == 6
    assert folded("MODERN") == folded("rnoclem") and folded("Été") == folded("ete")
    assert lk._words_in_a_row(np.array([0, 1, 2, 3, 4, 5, 20, 21, 22]), np.array([0, 3, 6, 9])) == 2


def letters(rnd, n):
    """Invented small pages with persons, numbers and addresses, and decoys."""
    firsts, tails = ["Jorun", "Klaas", "Fenna", "Odette", "Ulric", "Runa"], ["vik", "rell", "quist", "sby", "thar", "zen", "nov"]
    heads = ["Kest", "Dro", "Umb", "Skav", "Tar", "Zor", "Nev", "Quel", "Batt", "Prilg"]
    surname = lambda: rnd.choice(heads) + rnd.choice(["a", "o", "ri", "mu"]) + rnd.choice(tails)
    place = lambda: rnd.choice(["Tam", "Lun", "Rus", "Hul"]) + rnd.choice(["ford", "holm", "bury", "mouth"])
    out = []
    for _ in range(n):
        first = rnd.choice(firsts)
        out.append(rnd.choice([
            f"Yesterday Mrs. {surname()} gave the opening address at {place()}.", f"Signed, Dr. {first} {surname()}, QQ 12 34 56 C.", f"The brig Quelpesk made {place()} in 9 days. The prize went to {first} {surname()}, second Capt. {surname()}.",
            f"Apply to {first} {surname()}, {rnd.randrange(1, 99)} Larkfield Street, telephone 01632 960{rnd.randrange(100, 999)}.", f"Replies to {first.lower()}@mill.example.org before noon. Messrs. {surname()} Bros. offer oats.", f"Passport XX-{rnd.randrange(100, 999)}-1234 is reported missing. Bushels sold: 123-45-678, price steady.", f"Corn @ 41 cents, oats @ 5s 1d. From {place()} we hear that the wharf burned. Act No. 12-34-5678 of the quay.",
        ]))
    return out


def test_personal_information(spark):
    rnd = random.Random(6)
    model = fit(["\n".join(letters(rnd, 6)) for _ in range(150)])
    lines = ["Apply to Fenna Kestoquist, Flat 3, 14 Cresset", "Road, telephone 01632", "960123 or to klaas@sea.test.", "Bushels sold: 629-97-854, price steady.", "The brig Drobequist made Lunford. Rev. Umb-", "amuvik-Taroxnov lost passport XX-123-9876.", "Corn @ 49 cents per bushel."]
    pages = [page(1, lines), page(2, lines), page(3, [sentence(rnd, 5000), *lines]), (4, None, None, "x", "x"), (5, "", [], "x", "x")]
    df = spark.createDataFrame(pages, P)
    found = sorted((r["doc_id"], r["pii_kind"], r["line_no"]) for r in find_pii(df, model).collect())
    want = [("address", 0), ("email", 2), ("id_number", 5), ("name", 0), ("name", 4), ("phone", 1)]
    assert found == sorted([(d, k, n) for d in (1, 2) for k, n in want] + [(3, k, n + 1) for k, n in want])
    text = redact(df, model).where("doc_id = 1").first()
    assert text["n_items"] == 6
    assert text["redacted"].split("\n") == ["Apply to [NAME], [ADDRESS]", ", telephone [PHONE]", " or to [EMAIL].", lines[3], "The brig Drobequist made Lunford. [NAME]", " lost passport [ID_NUMBER].", lines[6]]
    assert redact(df, model).where("doc_id = 4").first()["redacted"] is None
    assert find_pii(df.where("false"), model).count() == 0


def test_best_path_and_expectations_are_those_of_all_paths():
    """Against every path of small clusters: the best one, and the chances that the fit moves by."""
    rnd = random.Random(7)
    model = fit(["\n".join(letters(rnd, 6)) for _ in range(60)])
    from itertools import combinations

    from isotwin.llm.pii import clusters

    seen = 0
    for text in ["\n".join(letters(rnd, 3)) for _ in range(60)]:
        for group in clusters(spans(text, model.names)):
            if not 1 < len(group) < 11:
                continue
            seen += 1
            group = sorted(group, key=lambda x: (x[1], x[0]))
            free = lambda xs: all(a[1] <= b[0] for a, b in zip(xs, xs[1:]))
            paths = [xs for n in range(len(group) + 1) for xs in combinations(group, n) if free(xs)]
            near = lambda a, b: b[0] - a[1] < 24
            total = lambda xs: sum(map(model.score, xs)) + sum(model.pair(text, a, b) for a, b in zip(xs, xs[1:]) if near(a, b))
            assert abs(total(model.best(text, group)) - max(map(total, paths))) < 1e-9
            given = [True] + [None] * (len(group) - 1)
            weight = np.exp([total(xs) for xs in paths])
            held = np.array([[x in xs for x in group] for xs in paths], float)
            bound = weight * held[:, 0]
            want = bound @ held / bound.sum() - weight @ held / weight.sum()
            chances, pairs = model.expected(text, group, given)
            assert np.allclose(chances, want, atol=1e-6)
            assert all(abs(d) <= len(group) for d in pairs.values())
    assert seen > 10


def test_page_places():
    p = Page([(0, "first broken wo-", 0), (2, "rd here", 0), (1, "other", 20)])
    assert p.text == "first broken word here other"
    at = p.text.index("word")
    assert p.line(at) == 0 and p.places(at, at + 4) == [(0, 13, 16), (2, 0, 2)] and p.places(23, 28) == [(1, 20, 25)]


def test_names_are_counted_on_all_pages(spark):
    """A first name that stands on no page of the sample, but on many others, begins a name."""
    from isotwin.llm.pii import Names, fitted

    rnd, sample = random.Random(8), 60
    pages = [(i, "\n".join(letters(rnd, 6))) for i in range(600)]
    sampled = {r["id"] for r in spark.range(600).where(f"pmod(xxhash64(id), {600 // sample}) = 0").collect()}
    others = [i for i, _ in pages if i not in sampled][:40]
    pages = [(i, text + f"\nThe prize went to Philippa {rnd.choice(['Kestoquist', 'Umbavik', 'Drorirell'])} at noon." if i in others else text) for i, text in pages]
    df = spark.createDataFrame([page(i, text.split("\n")) for i, text in pages], P)
    model = fitted(df.repartition(5), sample)
    whole = Names([Page([(k, line, 0) for k, line in enumerate(text.split("\n"))]).text for _, text in pages])
    assert model.names.part == whole.part and model.names.firsts == {w: x for w, x in whole.firsts.items() if x > -1} and "philippa" in model.names.firsts
    last = {(i, len(text.split("\n")) - 1) for i, text in pages if i in others}
    found = {(r["doc_id"], r["line_no"]) for r in find_pii(df, model).where("pii_kind = 'name'").collect()}
    assert len(last & found) == len(others)
    redacted = {r["doc_id"]: r["redacted"] for r in redact(df, model).collect()}
    assert not any("Philippa" in redacted[i] for i in others)


def test_odds_of_names_do_not_depend_on_size():
    from isotwin.llm.pii import LEAST, Names, _one_off

    rnd = random.Random(3)
    texts = ["\n".join(letters(rnd, 6)) for _ in range(1500)]
    once, thrice = Names(texts), Names(texts * 3)
    assert once.part.keys() == thrice.part.keys() and all(abs(x - thrice.part[p]) < 0.01 for p, x in once.part.items())
    rare = ["The prize went to Eustace Kestoquist, second Sehoner Umbavik."] * LEAST + ["The Schoner Kestoquist sank."] * 40
    firsts = Names(texts + rare).firsts
    assert "eustace" in firsts and "sehoner" not in firsts and "schoner" not in firsts
    assert _one_off("firrna", "firma") and _one_off("schner", "schoner") and _one_off("moison", "maison") and not _one_off("fenna", "firma")
