"""Personal information in scanned pages: find it, and put typed placeholders in its place.

Method: a semi-Markov conditional random field. Loose patterns propose whole spans, far more than are items; features of a span as a
whole (its own build, the words around it) give it a score per kind, and neighbouring spans a score for following one another;
bounded-entity dynamic programming over the proposed spans chooses boundaries and kinds jointly. There are no labelled rows. The field is
fitted on the conditional likelihood of weak labels in a bounded sample of pages: spans that a word announces (``Passport``, ``ring``,
``Mrs.``), spans that a word denies (``Lot``, ``Messrs``), and spans of which two independent views say the same. All other spans are left
open and summed over, so what becomes of them is the field's own decision. How names and numbers are built, and how often numbers of one
build are announced, is counted on all pages.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isotwin.llm.pages import page_columns, reading_order
from isotwin.session import cut

KINDS = ("address", "email", "id_number", "name", "phone")
#: Pages that the model is fitted on, spread over the whole table.
SAMPLE_PAGES = 1500
#: Sightings in the whole table from which a word counts as a first name; fewer are taken for misreadings.
LEAST = 3
#: A word part needs as many sightings per so many pages to tell for or against a surname (a rarer one tells nothing and bars
#: no name), and half a sighting is added to its counts: so the odds, and the limits set for them, do not drift with the table's size.
SMOOTHED_PAGES = 1500
#: A word one letter away from one that comes before firms or ships is taken for its misreading if seen at most this share as often.
MISREAD_SHARE = 0.1
#: Distinct runs of words that a task counts before it hands the counts on.
FLUSH = 200_000
#: Passes of the fit, its step and the weight decay.
EPOCHS, STEP, DECAY = 5, 0.2, 1e-4
#: Share of examples that are fitted without the words around their spans, so that a span's own build learns to tell by itself.
UNSEEN = 0.4
#: Spans fewer letters apart follow one another: the field scores the pair.
NEAR = 24
#: Most letters of a number or a name; longer runs are none.
LONGEST = 80

#: Marks with which a word is broken at a line's end.
BREAKS = "-=~¬­"
#: Titles of persons, in English, German and French.
TITLES = {"mr", "mrs", "miss", "ms", "dr", "rev", "capt", "prof", "sir", "lady", "col", "captain", "professor", "colonel", "reverend", "madame", "monsieur", "lieut", "maj", "sgt", "herr", "herrn", "frau", "frl", "m", "mm", "mme", "mlle", "me", "mgr"}
#: Words before and after the name of a firm, a ship or a trophy.
FIRM_BEFORE = {"messrs", "firma", "maison", "gebr", "gebrueder", "brothers", "haus", "firm", "ste", "societe", "company"}
FIRM_AFTER = {"&", "bros", "brothers", "sons", "co", "cup", "merchants", "'s", "gmbh", "patent", "pokal", "ltd", "coupe"}
SHIP_BEFORE = {"steamer", "brig", "sloop", "schooner", "schoner", "dampfer", "vapeur", "ship", "barque", "goelette", "brick", "segler", "cutter", "yacht", "ketch", "the", "le", "la", "das"}
#: Words that are no first names, though surnames follow them.
NEVER = SHIP_BEFORE | FIRM_BEFORE | TITLES
#: Kinds of counts (``Evidence.rows``) that make the parts' odds.
PARTS = ("yes", "no", "page")
#: Words that announce a telephone number, a number of a person or their papers, or that deny both (numbers of goods, lots, acts
#: and boxes), an email address, and a street address, in English, German and French.
PHONE_WORDS = {"telephone", "telephon", "telefon", "tel", "phone", "call", "ring", "dial", "fernruf", "fernsprecher", "ruf", "rufen", "anrufen", "rufnummer", "mobile", "fax", "appeler", "appelez", "telephoner"}
ID_WORDS = {"passport", "reisepass", "passeport", "identity", "identite", "ausweis", "personalausweis", "kennkarte", "card", "carte", "papers", "papiere", "papiers", "insurance", "social", "sozial", "sozialversicherung", "steuer", "steuer-id", "pensioner", "licence", "license", "ssn"}
THING_WORDS = {"lot", "lots", "los", "goods", "ware", "waren", "act", "akte", "akten", "arrete", "loi", "box", "kiste", "boite", "price", "preis", "prix"}
_ANNOUNCING = PHONE_WORDS | ID_WORDS | THING_WORDS
EMAIL_WORDS = {"mailto", "mail", "email", "e-mail", "write", "replies", "reply", "ecrire", "zuschriften", "schreiben", "correspondence", "word"}
PLACE_WORDS = {"at", "of", "to", "in", "from", "wohnt", "wohnhaft", "demeure", "au", "lives", "living", "address", "resides"}
#: Common first names, which tell where a table holds none of them.
COMMON_FIRST = set("""anna maria peter paul john james mary thomas william george charles henry robert david michael elizabeth margaret sarah jane alice emma
    edward joseph samuel daniel richard martin walter frank fred arthur albert louis hans karl fritz heinrich wilhelm otto hermann friedrich johann josef
    franz georg ernst ludwig erna frieda gertrud hedwig ilse käthe klara luise martha jean pierre jacques henri marcel andre rene lucien jules emile claude
    francois jeanne marie louise marguerite suzanne yvonne simone helene claire sophie julia laura eva olga ivan pavel jan piotr katarzyna sven lars erik
    ingrid carlos juan jose luis pedro antonio giovanni giuseppe marco paolo francesca lucia elena sofia""".split())
#: Kinds of street.
STREETS_EN = "street st road rd lane ln hill square sq terrace ter avenue ave quay row gardens place court close crescent drive way walk mews green parade grove boulevard blvd alley wharf circus embankment".split()
SHORT_STREETS = {"st", "rd", "ln", "sq", "ter", "ave", "blvd"}
STREETS_FR = "rue|quai|avenue|av\\.|impasse|boulevard|bd|place|allee|chemin|cours|square|passage|ruelle|route|faubourg|villa"
STREETS_DE = "strasse|straße|str\\.?|gasse|weg|platz|allee|ufer|hof|damm|ring|steig|markt|graben|chaussee|zeile|pfad"
#: Top-level domains of addresses.
DOMAINS = {"test", "example", "invalid", "com", "net", "org", "de", "fr", "uk", "info", "edu", "eu", "localhost"}

_CAP = r"(?:[A-Z]\.|[A-Z][\w’]*(?:-[A-Z]?[\w’]+)?\.?)"
_SEQUENCE = re.compile(rf"(?<![\w@.-]){_CAP}(?:,? {_CAP})*")
_AT = re.compile(r" ?(?:@|[\[({] ?(?:at|AT|arroba) ?[\])})]) ?")
_LOCAL = re.compile(r"[\w.+-]+$")
_DOMAIN = re.compile(r"(?:[\w-]+(?: ?(?:\.|[\[({] ?(?:dot|DOT|punkt|point) ?[\])}]) ?(?=[\w-])|))+")
_NUMBER = re.compile(r"(?<![\w@])(?:\+ ?|\()?(?:[A-Z]{1,3}[- ]?)?\d(?:[\dOlI]|[ /-](?=[\d(A-Z])|\.(?=\d)| ?\(\d+\) ?(?=\d)|\) ?(?=\d)| - (?=\d)|[A-Z](?=\b|\d))*")
_PREFIX = re.compile(r"(?<![\w@])([A-Z][A-Za-z]{1,9})[ -]?$")
_HOUSE = re.compile(r"(?<![\w/@])(?<!\d[.,-])\d{1,4}(?!\d)")
_BEFORE_HOUSE = re.compile(r"(?:(?<![\w/])(?i:flat|apt\.?|room) \d+\w?,? ?)?(?:(?<![\w/])(?i:no)\.? ?)?(?<![\w/])(?:\d+ ?- ?)?$")
_STREET_EN = re.compile(r"\d+(?: ?- ?\d+)?[A-Za-z]?,? (?:[A-Z][\w'’]+ ){1,2}[A-Z][A-Za-z]{1,8}\b\.?")
_STREET_FR = re.compile(rf"(?i)\d+(?: ?- ?\d+)?(?: ?(?:bis|ter|quater|[a-d]))?,? (?:{STREETS_FR}) (?:(?:de|du|des|la|le|les|l')[ ']?)*[A-Z]\w+")
_STREET_DE = re.compile(rf"(?:[A-Z][\w-]*(?i:{STREETS_DE})|(?:Am|An der|An den|Im|In der|Zum|Zur|Auf dem|AM|IM) [A-Z]\w+),? (?:Nr\.? ?)?$")
_AFTER_HOUSE = re.compile(r"\d+(?: ?- ?\d+)? ?[a-z]?\b(?:, ?\d+\. ?(?:Stock|Etage|OG))?")
_WORD = re.compile(r"[\w&@'.]+")
_DIGIT_LIKE = str.maketrans("OlI", "011")
_TO_MASK = str.maketrans("0123456789", "9999999999")
_LETTER_LIKE = str.maketrans("01", "ol")


# --- pages as text ---------------------------------------------------------------------------------


class Page:
    """A page's text in reading order, adverts after articles, with the way back to its lines.

    Words broken at a line's end are joined; a break before a capital or a digit keeps its hyphen.
    """

    def __init__(self, pieces: list[tuple[int, str, int]]) -> None:
        body, adverts, advert = [], [], False
        for p in pieces:
            bare = p[1].strip()
            if len(bare) > 3 and not bare.strip("*"):
                advert = True
            elif len(bare) > 3 and not bare.strip("-"):
                advert = False
            else:
                (adverts if advert else body).append(p)
        self.starts, self.pieces, self.dropped, out, at, last = [], [], [], [], 0, ""
        for k, (line, piece, place) in enumerate(body + adverts):
            left = piece.lstrip()
            place += len(piece) - len(left)
            text = left.rstrip()
            if not text:
                continue
            if out and k != len(body):
                if last[-1] in BREAKS and len(last) > 1 and last[-2].isalnum():
                    if text[0].islower():
                        out[-1] = out[-1][:-1]
                        at -= 1
                        self.dropped[-1] = 1
                    else:
                        out[-1] = out[-1][:-1] + "-"
                else:
                    out.append(" ")
                    at += 1
            elif out:
                out.append("\n")
                at += 1
            self.starts.append(at)
            self.pieces.append((line, place))
            self.dropped.append(0)
            out.append(text)
            at += len(text)
            last = text
        self.text = "".join(out)

    def line(self, at: int) -> int:
        return self.pieces[bisect.bisect_right(self.starts, at) - 1][0]

    def places(self, start: int, end: int) -> list[tuple[int, int, int]]:
        """The stretches ``line, from, to`` that ``start`` to ``end`` cover."""
        out = []
        k = bisect.bisect_right(self.starts, start) - 1
        while k < len(self.starts) and self.starts[k] < end:
            stop = self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text)
            line, place = self.pieces[k]
            a, b = max(start, self.starts[k]), min(end, stop)
            if a < b:
                # The break of a word that goes on in the next piece belongs to it.
                out.append((line, place + a - self.starts[k], place + b - self.starts[k] + (self.dropped[k] if end > stop else 0)))
            k += 1
        return out


# --- how names are built -----------------------------------------------------------------------------


def _parts(word: str) -> list[str]:
    w = word.lower().strip(".'’")
    return [f"<{w[:3]}", f"<{w[:4]}", f"{w[-2:]}>", f"{w[-3:]}>", f"{w[-4:]}>"]


class Evidence:
    """Counts of the runs of capitalized words and of the builds of numbers, from which ``Names`` are built."""

    def __init__(self) -> None:
        self.runs: Counter[str] = Counter()
        self.masks: Counter[tuple[str, str]] = Counter()
        self.pages = 0

    def add(self, text: str) -> None:
        self.pages += 1
        self.runs.update(_SEQUENCE.findall(text))
        for start, end in _number_places(text):
            self.masks[_mask(text[start:end]), _announced(text, start, end)] += 1

    def rows(self) -> Counter:
        """Counts by ``kind, a, b``, which add up over tasks: word parts after titles (``yes``) and alone (``no``), their sums at an
        empty ``a``, first names after titles (``titled``), successive words (``pair``) and last words (``last``); pages (``page``);
        builds of numbers and what announces them (``mask``)."""
        titled, alone, out = Counter(), Counter(), Counter({("page", "", ""): self.pages})
        for (mask, cue), n in self.masks.items():
            out["mask", mask, cue] += n
        for run, n in self.runs.items():
            words = run.replace(",", " ,").split()
            k = 0
            while k < len(words) and _is_title(words[k]):
                k += 1
            if k:
                # After a title: a surname, or a first name or initials and a surname, up to a point or comma.
                rest = []
                for w in words[k:]:
                    if w == ",":
                        break
                    if len(w) != 2 or w[1] != ".":
                        rest.append(w)
                        if w.endswith("."):
                            break
                if rest:
                    if len(rest) > 1:
                        out["titled", rest[0].lower(), ""] += n
                    titled[rest[min(1, len(rest) - 1)].split("-")[-1]] += n
            elif len(words) == 1 and len(words[0]) > 3:
                alone[words[0]] += n
            for a, b in zip(words, words[1:]):
                if len(a) > 2 and a.isalpha() and not a.isupper() and not _is_title(a):
                    out["pair", a.lower(), b.lower()] += n
            if words[-1].isalpha() and not words[-1].isupper() and words[-2:-1] != [","]:
                out["last", words[-1].lower(), ""] += n
        for kind, counts in (("yes", titled), ("no", alone)):
            for w, n in counts.items():
                out[kind, "", ""] += n
                for part in _parts(w):
                    out[kind, part, ""] += n
        return out


class Names:
    """Log-odds that a word is a surname, by its beginning and end, and that it is a first name, by itself."""

    def __init__(self, texts: list[str]) -> None:
        evidence = Evidence()
        for text in texts:
            evidence.add(text)
        rows = evidence.rows()
        self.count_parts((k, a, n) for (k, a, _), n in rows.items() if k in PARTS)
        self.count_masks(((a, b, n) for (k, a, b), n in rows.items() if k == "mask"), evidence.pages)
        first, other = Counter(), Counter()
        for (kind, a, b), n in rows.items():
            if kind not in (*PARTS, "mask"):
                first_name, other_word = self.weighed(kind, a, b, n)
                first[a] += first_name
                other[a] += other_word
        self.count_firsts([(w, n, other[w]) for w, n in first.items()])

    @classmethod
    def counted(cls, pages: DataFrame, every: int = 0) -> tuple[Names, list[str]]:
        """The names of all ``pages`` (``page_columns``), as the constructor's of all their texts; and the texts of one page in ``every`` by the
        hash of its id, at most twice as many as that gives of ``SAMPLE_PAGES * every`` pages.

        Pages are read once, counts are combined in the tasks and again by Spark. To the driver come only the parts and the builds of numbers
        that are frequent enough to tell, which are as many at any size, the first names with ``LEAST`` sightings whose odds let a span
        begin, and the sample.
        """

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Evidence()
            for batch in _sliced(batches):
                taken: Counter = Counter()
                for doc, sampled, pieces in zip(batch.column("doc_id").to_pylist(), batch.column("sampled").to_pylist(), reading_order(batch)):
                    text = Page(pieces).text
                    own.add(text)
                    if sampled:
                        taken["sample", text, str(doc)] += 1
                if taken:
                    yield _counts(taken)
                if len(own.runs) > FLUSH:
                    yield _counts(own.rows())
                    own = Evidence()
            yield _counts(own.rows())

        pages = pages.withColumn("sampled", F.expr(f"pmod(xxhash64(doc_id), {every}) = 0") if every else F.lit(False))
        rows = pages.mapInArrow(count, "kind string, a string, b string, n bigint").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
        rows = cut(rows)
        sample = [r["a"] for r in rows.where("kind = 'sample'").orderBy(F.xxhash64("b"), "a").limit(2 * SAMPLE_PAGES).collect()]
        rows = rows.where("kind <> 'sample'")
        parts = rows.where(F.col("kind").isin(*PARTS)).withColumn("every", F.sum("n").over(Window.partitionBy("a")))
        names = cls([])
        n_pages = rows.where("kind = 'page'").agg(F.sum("n")).first()[0] or 0
        enough = F.col("every") > (LEAST - 1) * max(1.0, n_pages / SMOOTHED_PAGES)
        names.count_parts((r["kind"], r["a"], r["n"]) for r in parts.where((F.col("a") == "") | enough).collect())
        masks = rows.where("kind = 'mask'").withColumn("every", F.sum("n").over(Window.partitionBy("a"))).where(enough)
        names.count_masks(((r["a"], r["b"], r["n"]) for r in masks.collect()), n_pages)
        sent = pages.sparkSession.sparkContext.broadcast(names)

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in batches:
                kinds, words, nexts, counts = (batch.column(c).to_pylist() for c in ("kind", "a", "b", "n"))
                pairs = [own.weighed(*x) for x in zip(kinds, words, nexts, counts)]
                yield pa.RecordBatch.from_arrays([batch.column("a"), pa.array([x for x, _ in pairs], pa.int64()), pa.array([x for _, x in pairs], pa.int64())], names=["a", "first", "other"])

        words = rows.where(~F.col("kind").isin(*PARTS, "mask")).mapInArrow(weigh, "a string, first bigint, other bigint")
        words = words.groupBy("a").agg(F.sum("first").alias("first"), F.sum("other").alias("other"))
        able = (F.col("first") >= LEAST) & (F.log((F.col("first") + 0.2) / (F.col("other") + 0.5)) > -1)
        names.count_firsts([(r["a"], r["first"], r["other"]) for r in words.where(able | F.col("a").isin(*NEVER)).collect()])
        return names, sample

    def count_masks(self, counts: Iterable[tuple[str, str, int]], pages: int) -> None:
        """How often numbers of each build are announced as a telephone number or as one of a person: steps of share, per build."""
        seen: dict[str, Counter] = defaultdict(Counter)
        for mask, cue, n in counts:
            seen[mask][cue] += n
        self.masks = {}
        for mask, own in seen.items():
            total = sum(own.values())
            if total > (LEAST - 1) * max(1.0, pages / SMOOTHED_PAGES):
                self.masks[mask] = (_step(own["phone"] / total), _step(own["id_number"] / total), total)

    def count_parts(self, counts: Iterable[tuple[str, str, int]]) -> None:
        yes, no, pages = Counter(), Counter(), 0
        for kind, part, n in counts:
            if kind == "page":
                pages = n
            else:
                (yes if kind == "yes" else no)[part] = n
        n_yes, n_no, more = yes.pop("", 0), no.pop("", 0), max(1.0, pages / SMOOTHED_PAGES)
        odds = lambda p: math.log((yes[p] + 0.5 * more) / (n_yes + more)) - math.log((no[p] + 0.5 * more) / (n_no + more))
        self.part = {p: odds(p) for p in sorted({*yes, *no}) if yes[p] + no[p] > (LEAST - 1) * more}
        self.cache: dict[str, float] = {}

    def weighed(self, kind: str, a: str, b: str, n: int) -> tuple[int, int]:
        """How many of ``n`` sightings make ``a`` a first name, and how many another word."""
        if kind == "titled":
            return n, 0
        if kind == "last":
            return 0, n * (self.surname(a) < 4)
        return (n, 0) if self.surname(b) > 4 and self.surname(a) < 4 else (0, n)

    def count_firsts(self, counts: list[tuple[str, int, int]]) -> None:
        seen = {w: n + other for w, n, other in counts}
        misread = lambda w: any(n <= MISREAD_SHARE * seen.get(x, 0) for n in [seen[w]] for x in NEVER if _one_off(w, x))
        self.firsts = {w: math.log((n + 0.2) / (other + 0.5)) for w, n, other in counts if n >= LEAST and w not in NEVER and not misread(w)}

    def surname(self, word: str) -> float:
        s = self.cache.get(word)
        if s is None:
            own = [p for p in word.rstrip(".").split("-") if len(p) > 2]
            s = min((sum(self.part.get(x, 0.0) for x in _parts(p)) for p in own), default=-9.0) if own and all(p[0].isalpha() for p in own) else -9.0
            if len(self.cache) < 200_000:
                self.cache[word] = s
        return s

    def first(self, word: str) -> float:
        if len(word) == 2 and word[1] == "." and word[0].isupper():
            return 1.0
        return self.firsts.get(word.lower().rstrip("."), -9.0)


def _one_off(word: str, other: str) -> bool:
    """Whether one letter put for another, left out or put in makes ``other`` of ``word``; letter pairs taken for one count as one."""
    w, x = (t.replace("rn", "m").replace("cl", "d") for t in (word, other))
    if abs(len(w) - len(x)) > 1 or min(len(w), len(x)) < 4:
        return False
    k = next((i for i, (p, q) in enumerate(zip(w, x)) if p != q), min(len(w), len(x)))
    return w[k + (len(w) >= len(x)) :] == x[k + (len(x) >= len(w)) :]


def _counts(rows: Counter) -> pa.RecordBatch:
    kind, a, b = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in (kind, a, b)), pa.array(list(rows.values()), pa.int64())], names=["kind", "a", "b", "n"])


def _is_title(word: str) -> bool:
    return word.rstrip(".").lower() in TITLES and word[0].isupper() and (len(word.rstrip(".")) > 1 or word in ("M.", "M"))


# --- spans and their features ------------------------------------------------------------------------

#: Start, end, kind, features of the span itself, features of what is around it.
Span = tuple[int, int, str, list[str], list[str]]


def _cue(word: str) -> str:
    """A word as a cue: lower case, without points, letters that scanners confuse mended."""
    return word.lower().strip(".'").replace("rn", "m").translate(_LETTER_LIKE)


def _around(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """The three words before a span, nearest first, and the two after it."""
    left = [_cue(w) for w in _WORD.findall(text[max(0, start - 40) : start])[:-4:-1]]
    right = [_cue(w) for w in _WORD.findall(text[end : end + 25])[:2]]
    return left, right


def _mask(s: str) -> str:
    """The build of a number: digits as 9, capitals as A, small letters as a."""
    t = s.translate(_DIGIT_LIKE) if sum(c.isdigit() for c in s) > 3 else s
    return re.sub("[a-z]+", "a", re.sub("[A-Z]", "A", t.translate(_TO_MASK)))


def _step(share: float) -> int:
    return 0 if share < 0.01 else 1 if share < 0.08 else 2 if share < 0.3 else 3


def _number_places(text: str) -> Iterator[tuple[int, int]]:
    """The longest runs that may be a number of a person or a telephone number."""
    for m in _NUMBER.finditer(text):
        s = m[0].rstrip(" -/.(")
        digits = sum(c.isdigit() for c in s)
        # A capital after the number may begin the next sentence.
        end = m.start() + len(s) - (2 if s[-2:-1] == " " and s[-1].isalpha() and s[-3:-2] in "." else 0)
        if 5 <= digits <= 20 and len(s) <= LONGEST:
            yield m.start(), end


def _announced(text: str, start: int, end: int) -> str:
    """What the words next to a number announce it as: ``phone``, ``id_number``, ``thing`` or nothing."""
    left, right = _around(text, start, end)
    return _cue_kind(left, right)


def _cue_kind(left: list[str], right: list[str]) -> str:
    near = left[:1] if not left or left[0] not in ("no", "nr", "nummer", "number", "numero", "klondike") else left[:2]
    for w in near:
        if w in THING_WORDS:
            return "thing"
        if w in ID_WORDS:
            return "id_number"
        if w in PHONE_WORDS:
            return "phone"
    if len(left) > 1 and left[0] in ("le", "la", "the", "bitte", "please", "on", "under", "unter") and left[1] in PHONE_WORDS or right and right[0] in ("anrufen", "rufen"):
        return "phone"
    return ""


def _numbers(text: str, names: Names) -> Iterator[Span]:
    for start, end in _number_places(text):
        s = text[start:end]
        yield from _number_span(text, start, end, names)
        if m := re.match(r"[A-Z]{1,3} (?=\+?\(?\d)", s):
            yield from _number_span(text, start + m.end(), end, names)
        # The name of an exchange may stand before the number, as letters or as a word.
        if (m := _PREFIX.search(text, max(0, start - 12), start)) and len(s) <= 8 and _cue(m[1]) not in _ANNOUNCING:
            yield from _number_span(text, m.start(1), end, names)
        if s[-2:-1] == " " and s[-1].isalpha():
            yield from _number_span(text, start, end - 2, names)
        # A long run of digits may be two items, or an item and a house number: its parts are proposed too.
        if " " in s and sum(c.isdigit() for c in s) > 9:
            for c in (i for i, x in enumerate(s) if x == " "):
                if 6 <= sum(x.isdigit() for x in s[:c]) and len(s) - c > 2:
                    yield from _number_span(text, start, start + c, names)


def _number_span(text: str, start: int, end: int, names: Names) -> Iterator[Span]:
    s = text[start:end]
    mask, digits = _mask(s), sum(c.isdigit() for c in s)
    left, right = _around(text, start, end)
    follows = text[end : end + 3].strip()
    whole = "cut" if follows[:1].isdigit() or (follows[:1].isupper() and not follows[1:2].isalpha() and not text[end : end + 1] == ".") else "whole"
    groups = [len(g) for g in re.findall(r"\d+", mask)]
    marks = re.sub(r"[9A-Za-z]+", "", mask)
    letters = re.sub(r"[^Aa]", "", mask)
    head = "A" if mask[0] == "A" else mask[0] if mask[0] in "+(" else s[0] if s[0] in "01" else "9"
    phone, own_id, seen = names.masks.get(mask, (-1, -1, 0))
    word = text[start:end].split(" ")[0] if letters.startswith("Aa") else ""
    own = [f"m={mask}", f"n={digits}", f"g={'.'.join(map(str, groups[:6]))}", f"k={len(groups)}", f"x={marks[:6]}", f"a={letters}", f"h={head}", f"hn={head}{digits}", f"last={groups[-1]}", f"mp={phone}", f"mi={own_id}", f"w={_cue(word)}", whole]
    cue = _cue_kind(left, right)
    around = [*(f"l={w}" for w in left), *(f"r={w}" for w in right[:1]), f"l1={left[0] if left else ''}", f"cue={cue}"]
    for kind in ("phone", "id_number"):
        yield start, end, kind, [f"{kind[0]}:{f}" for f in (*own, "bias")], [f"{kind[0]}:{f}" for f in around]


def _emails(text: str) -> Iterator[Span]:
    for m in _AT.finditer(text):
        local = _LOCAL.search(text, max(0, m.start() - 64), m.start())
        domain = _DOMAIN.match(text, m.end())
        if not (local and domain):
            continue
        start, d = local.start(), domain[0]
        left, _ = _around(text, start, m.end())
        # A sentence may go on after the address: shorter ends are proposed too.
        ends = [len(d), *[k.start() for k in re.finditer(r" ?[.\[({] ?", d)][::-1][:4]]
        for e in dict.fromkeys(ends):
            part = d[:e].rstrip(" .")
            labels = re.split(r" ?(?:\.|[\[({] ?(?:dot|DOT|punkt|point) ?[\])}]) ?", part)
            tail, after = labels[-1].lower(), d[e : e + 2].lower()
            follows = re.split("[^a-z]", d[e:].lower().lstrip(" .[({"))
            known = any(w in DOMAINS for w in follows[:2])
            blanks = part.count(" ") + m[0].count(" ")
            own = ["e:bias", f"e:tld={tail if tail in DOMAINS else 'other'}", f"e:known={tail in DOMAINS}", f"e:labels={min(3, len(labels) - 1)}", f"e:digit={part[:1].isdigit()}", f"e:case={part[:1].isupper() and not part.isupper()}", f"e:blank={min(2, blanks)}", f"e:more={re.sub('[a-z]', 'a', after)}", f"e:next={known}", f"e:at={m[0].strip()[:1]}"]
            yield start, m.end() + len(part), "email", own, [f"e:cue={bool(EMAIL_WORDS & set(left))}", f"e:l1={left[0] if left else ''}"]


def _near(word: str, words: list[str]) -> str:
    w = word.lower().rstrip(".").replace("cl", "d")
    if w in words:
        return "exact"
    for x in words:
        if len(x) > 3 and len(x) == len(w) and w[0] == x[0] and sum(a != b for a, b in zip(w, x)) == 1:
            return "near"
    return "none"


def _streets(s: str) -> list[tuple[str, int]]:
    """How the last word, and in a longer text the one before, names a kind of street, and the letters after it."""
    words = s.rstrip(" ,").split()
    out = [(_near(words[-1], STREETS_EN), 0)]
    if len(words) > 3:
        out.append((_near(words[-2], STREETS_EN), len(words[-1]) + 1))
    return [x for x in out if x[0] != "none"] or out[:1]


def _addresses(text: str) -> Iterator[Span]:
    for house in _HOUSE.finditer(text):
        at = house.start()
        if m := _STREET_FR.match(text, at):
            kind = "fr"
            start, s = _BEFORE_HOUSE.search(text, max(0, at - 24), at).start(), m[0].rstrip(" ,")
        elif (m := _STREET_DE.search(text, max(0, at - 40), at)) and (number := _AFTER_HOUSE.match(text, at)):
            kind, start, s = "de", m.start(), number[0]
        elif m := _STREET_EN.match(text, at):
            kind = "en"
            start, s = _BEFORE_HOUSE.search(text, max(0, at - 24), at).start(), m[0].rstrip(" ,")
        else:
            continue
        stop = at + len(s)
        left, right = _around(text, start, stop)
        before = text[max(0, start - 2) : start].strip()
        for f, less in _streets(s) if kind == "en" else [("exact", 0)]:
            e = stop - less
            # A point after a kind of street written out ends the sentence.
            if kind == "en" and text[e - 1] == "." and text[start : e - 1].split()[-1].lower() not in SHORT_STREETS:
                e -= 1
            after = text[e : e + 1]
            own = ["a:bias", f"a:{kind}={f}", f"a:f={f}", f"a:cap={f}{_caps(text[start:e])}", f"a:flat={'flat' in text[start:at].lower()}", f"a:up={text[start:e].isupper()}{f}"]
            around = [f"a:l1={left[0] if left and left[0].isalpha() else ''}", f"a:dig={left[0][-1:].isdigit() if left else False}", f"a:b={before[-1:] if before[-1:] in ',.;(' else ''}", f"a:a={after if after in ',.;' else ''}", f"a:cue={bool(left) and left[0] in PLACE_WORDS}"]
            yield start, e, "address", own, around


def _caps(s: str) -> str:
    words = [w for w in s.split() if w[0].isalpha()]
    return str(min(3, sum(w[0].isupper() for w in words)))


def _bucket(x: float) -> int:
    return -2 if x < -2 else -1 if x < 0 else min(4, int(x / 2.5))


def _names(text: str, names: Names) -> Iterator[Span]:
    for m in _SEQUENCE.finditer(text):
        s = m[0]
        if " " not in s:
            continue
        words = s.split(" ")
        bare = [t.rstrip(",") for t in words]
        titles = [_is_title(b) for b in bare]
        fir = [names.first(b) for b in bare]
        common = [b.lower() in COMMON_FIRST for b in bare]
        sur = [names.surname(b) for b in bare]
        begins = [t or f > -1 or c or (x > 0 and w.endswith(",")) for t, f, c, x, w in zip(titles, fir, common, sur, words)]
        if not any(begins):
            continue
        ends = [b.endswith(".") and len(b) > 2 and not t for b, t in zip(bare, titles)]
        at, starts = 0, []
        for t in words:
            starts.append(at)
            at += len(t) + 1
        for i in range(len(words)):
            if not begins[i]:
                continue
            for j in range(i, min(i + 6, len(words))):
                comma = any(words[k].endswith(",") for k in range(i, j))
                backward = comma and sur[i] > 0 and words[i].endswith(",") and not any(words[k].endswith(",") for k in range(i + 1, j)) and all(fir[k] > -1 or common[k] for k in range(i + 1, j + 1))
                if comma and not backward:
                    break
                # A word that ends with a point ends the sentence, if it is no title or initial.
                if any(ends[i:j]):
                    break
                if titles[j] or (len(bare[j]) < 3 and not backward):
                    continue
                n_title = sum(titles[i : j + 1])
                firsts = [k for k in (range(i + 1, j + 1) if backward else range(i + n_title, j)) if fir[k] > -1 or common[k]]
                if n_title + len(firsts) == 0 or j - i + 1 - n_title < 1:
                    continue
                start, end = m.start() + starts[i], m.start() + starts[j] + len(bare[j])
                if bare[j].endswith(".") and len(bare[j]) > 2:
                    end -= 1
                odd = 0 if backward else sum(not titles[k] and fir[k] <= -1 and not common[k] for k in range(i, j))
                before, after = _around(text, start, end)
                tail = text[end : end + 6].lower().lstrip(" .,")
                firm = ("before" if (before and before[0] in FIRM_BEFORE) or (i and bare[i - 1].lower().rstrip(".") in FIRM_BEFORE) else "") + ("after" if (after and after[0] in FIRM_AFTER) or text[end : end + 2] in ("'s", "’s") or tail.startswith(("et fils", "und soe")) else "")
                near = bare[i - 1].lower() if i else (before[0] if before else "")
                wider = "left" if i and begins[i - 1] and not words[i - 1].endswith(",") else ""
                wider += "right" if j + 1 < len(words) and sur[j + 1] > 4 and not bare[j].endswith(".") and not words[j].endswith(",") else ""
                best = _bucket(sur[i] if backward else sur[j])
                rare = "common" if any(common[k] and fir[k] <= -1 for k in firsts) else "seen" if any(len(bare[k]) > 2 for k in firsts) else "initial" if firsts else "none"
                t, f = min(2, n_title), min(2, len(firsts))
                own = ["n:bias", f"n:t={t}", f"n:f={f}", f"n:s={best}", f"n:o={min(2, odd)}", f"n:wide={wider}", f"n:back={backward}", f"n:ts={min(1, t)}{best}", f"n:fs={rare}{best}", f"n:w={j - i + 1 - n_title}", f"n:up={text[start:end].isupper()}{min(1, t)}"]
                yield start, end, "name", own, [f"n:firm={firm}", f"n:ship={near in SHIP_BEFORE}{min(1, t)}", f"n:l1={before[0] if before else ''}", f"n:r1={after[0] if after else ''}"]


def spans(text: str, names: Names) -> list[Span]:
    """All proposed spans, by start and end."""
    out = [*_emails(text), *_addresses(text), *_numbers(text, names), *_names(text, names)]
    return sorted(out, key=lambda x: (x[0], x[1], x[2]))


def clusters(proposed: list[Span]) -> Iterator[list[Span]]:
    """Groups of spans that overlap or stand near one another, directly or through others: the field scores them jointly."""
    group: list[Span] = []
    reach = -1
    for x in proposed:
        if group and x[0] >= reach + NEAR:
            yield group
            group = []
            reach = -1
        group.append(x)
        reach = max(reach, x[1])
    if group:
        yield group


# --- the model ---------------------------------------------------------------------------------------


def _gap(text: str, end: int, start: int) -> str:
    """How two spans that follow one another are parted: by marks alone, or by words."""
    return "mark" if not any(c.isalnum() for c in text[end:start]) else "word"


class Model:
    """The fitted field: weights by feature, and how names and numbers are built.

    A path is a sequence of spans that do not overlap; its score is the sum of its spans' scores and, of each two successive spans less
    than ``NEAR`` letters apart, that of the pair of kinds and of what parts them. Text outside spans scores 0.
    """

    def __init__(self, names: Names) -> None:
        self.names = names
        self.weights: dict[str, float] = defaultdict(float)

    def score(self, x: Span, around: bool = True) -> float:
        get = self.weights.get
        s = 0.0
        for f in x[3]:
            s += get(f, 0.0)
        if around:
            for f in x[4]:
                s += get(f, 0.0)
        return s

    def pair(self, text: str, x: Span, y: Span) -> float:
        return self.weights.get(f"t:{x[2]}>{y[2]}:{_gap(text, x[1], y[0])}", 0.0)

    def best(self, text: str, group: list[Span]) -> list[Span]:
        """The path of a cluster with the highest score."""
        if len(group) == 1:
            return group if self.score(group[0]) > 0 else []
        by_end = sorted(group, key=lambda x: (x[1], x[0]))
        ends = [x[1] for x in by_end]
        # value: the best path that ends with span k; top: the best of those that end with one of the first k, or none.
        value, back, top = [], [], [(0.0, -1)]
        for k, x in enumerate(by_end):
            far = bisect.bisect_right(ends, x[0] - NEAR, 0, k)
            most, come = top[far]
            for i in range(far, bisect.bisect_right(ends, x[0], 0, k)):
                v = value[i] + self.pair(text, by_end[i], x)
                if v > most:
                    most, come = v, i
            value.append(most + self.score(x))
            back.append(come)
            top.append((value[k], k) if value[k] > top[k][0] else top[k])
        out, k = [], top[-1][1]
        while k >= 0:
            out.append(by_end[k])
            k = back[k]
        return out[::-1]

    def expected(self, text: str, group: list[Span], given: list[bool | None], around: bool = True) -> tuple[np.ndarray, dict[str, float]]:
        """What the labels say beyond the field: for each span, and each pair feature, the chance that it is on the path, given that spans
        labelled true are and those labelled false are not, less that chance without the labels.

        Forward and backward sums over the proposed spans, sorted by their ends.
        """
        n = len(group)
        s = [self.score(x, around) for x in group]
        links: list[list[tuple[int, str, float]]] = [[] for _ in range(n)]
        before: list[list[int]] = [[] for _ in range(n)]
        for j, y in enumerate(group):
            for i in range(j):
                if group[i][1] <= y[0]:
                    if y[0] - group[i][1] < NEAR:
                        f = f"t:{group[i][2]}>{y[2]}:{_gap(text, group[i][1], y[0])}"
                        links[j].append((i, f, self.weights.get(f, 0.0)))
                    else:
                        before[j].append(i)
        chances, pairs = np.zeros(n), defaultdict(float)
        for sign in (1, -1):
            own = [x + (0.0 if sign < 0 or g is None else 40.0 if g else -40.0) for x, g in zip(s, given)]
            a, b = [0.0] * n, [0.0] * n
            for j in range(n):
                a[j] = own[j] + _sum_exp([0.0, *(a[i] + w for i, _, w in links[j]), *(a[i] for i in before[j])])
            after: list[list[float]] = [[0.0] for _ in range(n)]
            for j in range(n - 1, -1, -1):
                b[j] = own[j] + _sum_exp(after[j])
                for i, _, w in links[j]:
                    after[i].append(b[j] + w)
                for i in before[j]:
                    after[i].append(b[j])
            z = _sum_exp([0.0, *a])
            for j in range(n):
                chances[j] += sign * math.exp(min(0.0, a[j] + b[j] - own[j] - z))
                for i, f, w in links[j]:
                    pairs[f] += sign * math.exp(min(0.0, a[i] + w + b[j] - z))
        return chances, pairs

    def find(self, text: str) -> list[Span]:
        return [x for g in clusters(spans(text, self.names)) for x in self.best(text, g)]


def _sum_exp(xs: list[float]) -> float:
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs))


def _label(text: str, x: Span, names: Names) -> bool | None:
    """Whether a proposed span is announced as an item of its kind (true), denied (false), or neither (None)."""
    start, end, kind, own, around = x
    if kind == "email":
        if "e:known=False" in own or "e:next=True" in own:
            return False if "e:labels=0" in own and "e:at=@" in own else None
        return True if "e:cue=True" in around and "e:digit=False" in own and "e:case=False" in own else None
    if kind == "address":
        if "a:f=exact" in own:
            return True if "a:cue=True" in around or "a:b=," in around else None
        return False if "a:f=none" in own and "a:cue=False" in around and "a:b=," not in around else None
    if kind == "name":
        if "n:firm=" not in around:
            return False
        titled = "n:t=0" not in own
        if "n:ship=True0" in around:
            return False
        if "n:wide=" not in own or "n:o=0" not in own:
            return False if not titled and "n:s=-2" in own else None
        strong = bool({"n:s=2", "n:s=3", "n:s=4"} & set(own))
        if titled:
            return True if strong or "n:s=1" in own else None
        # Two views: a first name elsewhere after titles, and a last word built like the surnames.
        if strong and ("n:fs=seen" in own[8] or "n:fs=initial" in own[8]):
            return True
        return False if "n:s=-2" in own else None
    cue = _cue_kind(*_around(text, start, end))
    phone, own_id, seen = names.masks.get(_mask(text[start:end]), (-1, -1, 0))
    if cue == "thing" or f"{kind[0]}:cut" in own:
        return False
    if cue:
        # What the announced number's build says elsewhere must not speak against it.
        step = {"phone": phone, "id_number": own_id}[cue]
        return None if step in (0, 1) else cue == kind
    # Two views: no word announces it, and numbers of its build are hardly ever announced.
    return False if seen and max(phone, own_id) <= 0 else None


def fit(texts: list[str], names: Names | None = None) -> Model:
    """A model fitted on the weak labels in ``texts`` (``_label``); unlabelled spans are summed over. The same texts give the same model.

    ``names``: how names and numbers are built, if it was counted on more than ``texts``.
    """
    model = Model(names or Names(texts))
    examples = []
    for text in texts:
        for g in clusters(spans(text, model.names)):
            g = sorted(g, key=lambda x: (x[1], x[0]))
            given = [_label(text, x, model.names) for x in g]
            # Of true spans that overlap the longest holds, and what overlaps a true span is none.
            taken: list[Span] = []
            for i in sorted(range(len(g)), key=lambda i: (g[i][0] - g[i][1], g[i][2])):
                if given[i]:
                    given[i] = not any(g[i][0] < t[1] and t[0] < g[i][1] for t in taken)
                    if given[i]:
                        taken.append(g[i])
            given = [False if not y and any(x[0] < t[1] and t[0] < x[1] for t in taken) else y for x, y in zip(g, given)]
            if any(y is not None for y in given):
                examples.append((text, g, given))
    squares: dict[str, float] = defaultdict(float)

    def move(f: str, d: float) -> None:
        step = d - DECAY * model.weights[f]
        squares[f] += step * step
        model.weights[f] += STEP * step / math.sqrt(squares[f] + 1e-8)

    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(examples)):
            text, g, given = examples[k]
            around = rng.random() >= UNSEEN
            if len(g) == 1:
                chances, pairs = [float(given[0]) - 1 / (1 + math.exp(-max(-30.0, min(30.0, model.score(g[0], around)))))], {}
            else:
                chances, pairs = model.expected(text, g, given, around)
            for x, d in zip(g, chances):
                if abs(d) > 1e-3:
                    for f in x[3]:
                        move(f, d)
                    if around:
                        for f in x[4]:
                            move(f, d)
            for f, d in pairs.items():
                if abs(d) > 1e-3:
                    move(f, d)
    model.weights = dict(model.weights)
    return model


# --- the operator ------------------------------------------------------------------------------------


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def fitted(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Model:
    """A model whose names and builds of numbers are counted on all ``pages``, its weights fitted on about ``sample_pages`` spread by the hash of their id."""
    every = max(1, pages.count() // sample_pages)
    names, texts = Names.counted(pages.where("text is not null").select("doc_id", *page_columns()), every)
    return fit(texts, names)


def find_pii(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """Every item of personal information: ``doc_id, pii_kind, line_no, spots``.

    ``pages``: ``doc_id, text, boxes``. ``line_no`` counts from 0 and is the line on which the item begins; ``spots`` are the
    stretches ``line, from, to`` it covers, more than one where it runs over a line's end. Null and empty texts give nothing; pages
    stored twice are both searched; pages of any length are searched whole. Other columns are not read.

    Scale: two passes over the pages, the first to count how names are built (its counts are shuffled, the pages never); the weights
    are fitted on a bounded sample. What is sent to the tasks grows with the distinct first names alone.
    """
    model = model or fitted(pages)
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in _sliced(batches):
            out: list[tuple] = []
            for doc, pieces in zip(batch.column("doc_id").to_pylist(), reading_order(batch)):
                page = Page(pieces)
                for start, end, kind, *_ in own.find(page.text):
                    out.append((doc, kind, page.line(start), [{"line": a, "from": b, "to": c} for a, b, c in page.places(start, end)]))
            if out:
                spot = pa.list_(pa.struct([("line", pa.int32()), ("from", pa.int32()), ("to", pa.int32())]))
                doc, kind, line, spots = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(kind), pa.array(line, pa.int64()), pa.array(spots, spot)], names=["doc_id", "pii_kind", "line_no", "spots"])

    slim = pages.where("text is not null").select("doc_id", *page_columns())
    return slim.mapInArrow(find, "doc_id bigint, pii_kind string, line_no bigint, spots array<struct<line int, from int, to int>>")


def redact(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, redacted, n_items``: each page's text with ``[KIND]`` in place of every item, its lines as they were.

    An item that runs over a line's end leaves its placeholder on the line where it begins. Null texts stay null; see ``find_pii``.
    """
    model = model or fitted(pages)
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in _sliced(batches):
            texts, counts = [], []
            for text, pieces in zip(batch.column("text").to_pylist(), reading_order(batch)):
                if text is None:
                    texts.append(None)
                    counts.append(0)
                    continue
                page, lines, cuts = Page(pieces), text.split("\n"), []
                found = own.find(page.text)
                for start, end, kind, *_ in found:
                    for k, (line, a, b) in enumerate(page.places(start, end)):
                        cuts.append((line, a, b, f"[{kind.upper()}]" if k == 0 else ""))
                for line, a, b, put in sorted(cuts, reverse=True):
                    lines[line] = lines[line][:a] + put + lines[line][b:]
                texts.append("\n".join(lines))
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["doc_id", "redacted", "n_items"])

    return pages.select("doc_id", *page_columns()).mapInArrow(replace, "doc_id bigint, redacted string, n_items int")
