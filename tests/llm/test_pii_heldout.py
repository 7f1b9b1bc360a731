"""The field against its own weak labels on hand-labelled sentences: numbers of no reserved range, names, streets and wordings that no
test table holds. All persons and numbers are invented."""

import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from sqlcheck import FOLDER

from isotwin.llm.pages import reading_order
from isotwin.llm.pii import KINDS, Page, _label, fit, spans

PAGES = FOLDER.parent / "sf0.01" / "documents.parquet"
pytestmark = pytest.mark.skipif(not PAGES.exists(), reason="no test tables here")

#: <kind:text> marks an item.
HELD_OUT = """
Please call our agent <name:Mr. Peter Smith>, <address:12 Wilshire Boulevard>, telephone <phone:(212) 736 5000>, before Friday.
The keys are held by <name:Anna Kowalski>, <address:48 Chapel Lane>. Her passport <id_number:AB 12 34 56 C> was found on the tram.
Complaints reach <email:jane.doe@gmail.com> or <phone:+1 415 867 5309> at any hour.
We thank <name:Dr. Ingrid Halvorsen> for her paper. The mill made 123,456 yards of cloth in 1911.
Lot 48213-77 was sold to <name:Mrs. Adeline Ferncastle> for 46 pounds.
<name:Carlos Vermeulen>, <phone:020 7123 4567>, seeks a position as a clerk.
The number <phone:01273 486221> answers day and night.
Card <id_number:512-48-7731> in the name of <name:Martha Lindqvist> lies at the office.
Messrs. Pemberton & Co., Est. 1856, have sold 88-41-3275 sacks.
The steamer Maria Theresia left on 14-08-1931 for Lisbon.
A fine was laid on <name:Rev. Thomas Okonkwo>, of <address:7 Harbour Row>.
Letters to <name:Miss Eleanor Whitcombe>, <address:Flat 2, 115 Abbey Crescent>, <email:e.whitcombe@abbey-school.org.uk>.
Evidence was heard from <name:Ivan Petrov> and then from <name:Mme Claire Dubois>.
Rooms to let at <address:33 Juniper Street>; ring <phone:0161 496 2288> evenings.
Pensioner <id_number:KM 77 21 09 D> may draw at the counter.
Signed, <name:George Ashdown>, <id_number:648-22-9015>.
Witness <name:Laura Bianchi> showed papers no. <id_number:C40118263> to the bench.
The train of 18.45 to Leeds carried 250 passengers, price 3/6 each.
Act No. 31-07-2264 of the council is repealed. Ref. 71-4402, box 318.
<name:Herr Wilhelm Brandauer>, <address:Lindenstrasse 42>, Telefon <phone:0451 773 2918>, sucht ein Zimmer.
Der Ausweis <id_number:L8841 2076> auf <name:Frau Hedwig Sommer> wurde gefunden.
Zuschriften an <email:sommer@post.example-verlag.de> erbeten. Los Nr. 4471-02, Ziehung am 11.03.1928.
Zu melden bei <name:Karl Obermaier>, <address:Am Mühlgraben 9>, Fernruf <phone:0711/442 8106>.
S'adresser a <name:M. Lucien Morel>, <address:27, rue de la Fontaine>, telephone <phone:04 72 61 38 90>.
La carte <id_number:2 84 07 69 123 456 78> de <name:Mlle Suzanne Girard> fut perdue.
Ecrire a <email:girard@maison-bleue.fr> avant midi. Arrete no 4 18 22 du conseil.
<name:Paolo Ferrante> opened the fair at <address:90 Station Road>, near Thornbury.
The prize went to <name:Captain Hugh Darnley>, second <name:Jan Novak>.
Social no. <id_number:377-60-1142>, says the register.
The house at <address:5 Larch Grove> belongs to <name:Olga Sorensen>; dial <phone:555 0311>.
Cat. No. 5520-1187, price 7/5 post free. Bond series MK 402 118 drew 900 pounds.
Corn @ 44 cents, oats @ 5s 2d. On Monday 4,500 bushels were shipped.
Married, <name:Henry Castellane> and <name:Louise Aubrey>, both of this parish.
Wegen Holz bitte <phone:0345 612 9087> anrufen.
Write <email:fundraising@hospice-wells.org> or call <phone:KL4-7718> for terms.
The organ bears the number <id_number:409-33-8127> and the bell the name <name:Sophie Delacroix>.
Signed, <name:Prof. Edward Linton>, <id_number:XK 10 44 82 B>.
<name:Mrs. Johnson> lives at <address:210 Orchard Drive>.
From Westhaven we hear that the Chapel Street bridge is closed since 1926.
Telephone <phone:+44 1273 880 441>. The cup of 1899 weighs 2,140 grams.
""".strip().split("\n")


def parsed(line):
    text, gold = "", set()
    for part in re.split(r"(<\w+:[^>]+>)", line):
        if m := re.fullmatch(r"<(\w+):([^>]+)>", part):
            gold.add((m[1], len(text), len(text) + len(m[2])))
            text += m[2]
        else:
            text += part
    return text, gold


@pytest.fixture(scope="module")
def scores():
    table = pq.read_table(PAGES, columns=["text", "boxes"]).combine_chunks()
    boxes = table.column("boxes").to_pylist()
    edges = [pa.array([None if b is None else [x[c] for x in b] for b in boxes], pa.list_(pa.int32())) for c in ("x0", "y0")]
    batch = pa.RecordBatch.from_arrays([table.column("text").combine_chunks(), *edges], names=["text", "x0", "y0"])
    model = fit([Page(p).text for p in reading_order(batch) if p])
    out = {}
    for way in ("field", "labels"):
        tally = {k: [0, 0, 0] for k in KINDS}
        for line in HELD_OUT:
            text, gold = parsed(line)
            if way == "field":
                got = {(x[2], x[0], x[1]) for x in model.find(text)}
            else:
                true, got = [x for x in spans(text, model.names) if _label(text, x, model.names)], set()
                for x in sorted(true, key=lambda x: (x[0] - x[1], x[2])):
                    if not any(x[0] < e and s < x[1] for _, s, e in got):
                        got.add((x[2], x[0], x[1]))
            for k in KINDS:
                a, b = {x for x in gold if x[0] == k}, {x for x in got if x[0] == k}
                for i, x in enumerate((a & b, a, b)):
                    tally[k][i] += len(x)
            if way == "field":
                out.setdefault("wrong", []).append((sorted(text[s:e] for _, s, e in gold - got), sorted((k, text[s:e]) for k, s, e in got - gold)))
        out[way] = tally
    return out


def f1(tally):
    both, gold, got = (sum(t[i] for t in tally.values()) for i in range(3))
    return 2 * both / (gold + got)


def test_the_field_does_better_than_its_labels(scores):
    assert f1(scores["field"]) > f1(scores["labels"]) + 0.1, scores
    assert f1(scores["field"]) >= 0.8, scores


def test_each_kind_is_found(scores):
    for k, (both, gold, got) in scores["field"].items():
        assert both / gold >= 0.6 and both / max(1, got) >= 0.7, (k, scores["field"], scores["wrong"])
