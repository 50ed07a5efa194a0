"""Invented documents with answer keys, laid out on pages: row n is the same on any cluster, and there are as many as there are numbers.

Every value is a function of the document's number and a slot; national ids, tax and company numbers, accounts and identity cards have
valid check digits. A document is one of thirteen kinds, each a list of pages of pieces; a piece is plain text or a value with the kind of
span that it is. Keys are where those pieces lie.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactica.functions import catalogue as C
from redactica.functions import spans as S

#: Points: left and upper edge of a page's text, width of a letter, height of a line and of its letters.
LEFT, TOP, WIDTH, LINE, HEIGHT = 50.0, 40.0, 6.0, 12.0, 10.0
FIRST = ("Zofia", "Marek", "Halina", "Tadeusz", "Irena", "Jerzy", "Wanda", "Leon")
LAST = ("Wierzbicka", "Sosnowski", "Lipowska", "Dębski", "Jaworska", "Klonowicz", "Brzozowska", "Bukowski")
TOWNS = ("Kamionka", "Zalesie", "Jastrowo", "Olszyna", "Borowiec")
STREETS = ("Lipowa", "Klonowa", "Polna", "Szkolna", "Ogrodowa", "Kwiatowa", "Leśna")
FIRMS = ("Kwiatek", "Rzemiosło", "Budowlanka", "Wzorcowa", "Stolarnia")


def number(slot: int, least: int, most: int) -> str:
    """SQL of a whole number for document n and the piece x, by a fixed rule."""
    return f"(((n * 7919 + (x.slot + {slot}) * 104729 + 12345) % 2147483647) * 48271 % 2147483647 % {most - least + 1} + {least})"


def _bound(name: str, value: str, then: str) -> str:
    """SQL of an expression that names a value more than once."""
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def _digits(slot: int, size: int) -> str:
    return f"lpad(cast({number(slot, 0, 10**size - 1)} as string), {size}, '0')"


def _two(slot: int, least: int, most: int) -> str:
    return f"lpad(cast({number(slot, least, most)} as string), 2, '0')"


def _of(slot: int, values: tuple[str, ...]) -> str:
    return f"element_at(array({', '.join(repr(v) for v in values)}), cast({number(slot, 1, len(values))} as int))"


def _sum(text: str, weights: tuple[int, ...]) -> str:
    return "(" + " + ".join(f"cast(substr({text}, {k + 1}, 1) as int) * {w}" for k, w in enumerate(weights)) + ")"


def _pesel() -> str:
    head = f"concat({_two(0, 50, 99)}, {_two(1, 1, 12)}, {_two(2, 1, 28)}, {_digits(3, 4)})"
    return _bound("h", head, f"concat(h, cast((10 - {_sum('h', C.PESEL_WEIGHTS)} % 10) % 10 as string))")


def _nip() -> str:
    head = f"concat(cast({number(0, 111, 998)} as string), {_digits(1, 6)})"
    # where the check digit would be ten, the ninth digit is another one
    other = f"case when {_sum('h', C.NIP_WEIGHTS)} % 11 = 10 then concat(substr(h, 1, 8), cast((cast(substr(h, 9, 1) as int) + 1) % 10 as string)) else h end"
    whole = _bound("g", _bound("h", head, other), f"concat(g, cast({_sum('g', C.NIP_WEIGHTS)} % 11 as string))")
    return _bound("w", whole, "concat(substr(w, 1, 3), '-', substr(w, 4, 3), '-', substr(w, 7, 2), '-', substr(w, 9, 2))")


def _regon() -> str:
    return _bound("h", _digits(0, 8), f"concat(h, cast({_sum('h', C.REGON_WEIGHTS)} % 11 % 10 as string))")


def _iban() -> str:
    parts = f"array({', '.join(_digits(k, 4) for k in range(6))})"
    check = "lpad(cast(98 - cast(concat(array_join(a, ''), '252100') as decimal(38, 0)) % 97 as string), 2, '0')"
    return _bound("a", parts, f"concat('PL', {check}, ' ', array_join(a, ' '))")


def _card() -> str:
    return _bound("h", _digits(0, 5), f"concat('ABC', cast((7 * 10 + 3 * 11 + 12 + {_sum('h', (7, 3, 1, 7, 3))}) % 10 as string), h)")  # A, B, C count 10, 11, 12


#: Kinds of spans and SQL of the value of each.
VALUES = {
    "pesel": _pesel(), "nip": _nip(), "regon": _regon(), "iban": _iban(), "id_card": _card(),
    "phone": f"concat('6', {_digits(0, 8)})",
    "email": f"concat('k', cast({number(0, 1, 9999)} as string), '@poczta.test')",
    "person_private": f"concat({_of(0, FIRST)}, ' ', {_of(1, LAST)})",
    "address": f"concat('ul. ', {_of(0, STREETS)}, ' ', cast({number(1, 1, 99)} as string))",
    "postal_code": f"concat({_digits(0, 2)}, '-', {_digits(1, 3)})",
    "place_name": _of(0, TOWNS),
    "company_name": f"concat({_of(0, FIRMS)}, ' Polska Sp. z o.o.')",
    "facility_name": f"concat('Szkoła Podstawowa im. Marii ', {_of(0, ('Dolnej', 'Górnej', 'Leśnej'))})",
    "birth_date": f"concat({_two(0, 1, 28)}, '.', {_two(1, 1, 12)}, '.19', cast({number(2, 40, 99)} as string))",
    "case_reference": f"concat('II K ', cast({number(0, 1, 999)} as string), '/', {_digits(1, 2)})",
    "historical_date": f"concat(cast({number(0, 1, 28)} as string), ' maja 18', cast({number(1, 10, 99)} as string))",
    "statute_reference": f"concat('ustawa z dnia ', cast({number(0, 1, 28)} as string), ' marca 20', {_two(1, 1, 20)}, ' r.')",
    "public_figure": _of(0, ("Fryderyk Chopin", "Maria Skłodowska", "Mikołaj Kopernik")),
}

_HOME = "{address}, {postal_code} {place_name}"
#: The kinds of documents: pages of lines; braces hold the kind of a span.
KINDS: dict[str, tuple[str, ...]] = {
    "invoice": (f"Faktura\nSprzedawca: {{company_name}}\nNIP: {{nip}}\nREGON: {{regon}}\n{_HOME}\nkonto {{iban}}", "Nabywca {person_private}\ne-mail {email}\ntel. {phone}"),
    "contract": (f"Umowa najmu\nNajemca {{person_private}}, PESEL {{pesel}}\nzamieszkały {_HOME}\ndowód {{id_card}}", "Podstawa: {statute_reference}\nkontakt {phone}"),
    "complaint": (f"Reklamacja\n{{person_private}}\n{_HOME}\nproszę o zwrot na konto {{iban}}\ne-mail {{email}}",),
    "medical": ("Karta pacjenta\nPacjent {person_private}\nPESEL {pesel}\nur. {birth_date}\ntel. {phone}", "Skierowany przez {person_private}\nulica: {address}"),
    "court": ("Sąd Rejonowy\nsygn. {case_reference}\nPowód {person_private}\nPESEL {pesel}\nna podstawie: {statute_reference}",),
    "employment": (f"Umowa o pracę\nPracodawca {{company_name}}, REGON {{regon}}\nPracownik {{person_private}}\nurodzony {{birth_date}}\n{_HOME}",),
    "bank": ("Wyciąg\nPosiadacz {person_private}\nrachunek {iban}\ne-mail {email}\nNIP {nip}",),
    "school": ("Świadectwo\n{facility_name}\nzałożona {historical_date} r.\npatron: {public_figure}\nUczeń {person_private}\nur. {birth_date}",),
    "parcel": (f"Nadawca {{person_private}}\n{_HOME}\ntel. {{phone}}", f"Odbiorca {{company_name}}\n{_HOME}"),
    "minutes": ("Protokół zebrania\nobecni: {person_private}, {person_private}\nwspomniano {public_figure} i {historical_date} r.\nkontakt: {email}",),
    "mandate": ("Pełnomocnictwo\nMocodawca {person_private}, PESEL {pesel}, dowód {id_card}\nPełnomocnik {person_private}, PESEL {pesel}, dowód {id_card}",),
    "resume": (f"Życiorys\n{{person_private}}\nur. {{birth_date}}\n{_HOME}\ntel. {{phone}}\n{{email}}\nukończona {{facility_name}}",),
    "register": ("Wpis do rejestru\n{company_name}\nNIP {nip}\nREGON {regon}\nkonto {iban}\ne-mail {email}",),
}


def _templates() -> list[list[list[tuple[str | None, str | None, int]]]]:
    """The kinds' pages of pieces: text, or the kind of a span and its first slot."""
    out, slot = [], 0
    for pages in KINDS.values():
        out.append([])
        for page in pages:
            out[-1].append([])
            for text, kind in re.findall(r"([^{]+)|\{(\w+)\}", page):
                out[-1][-1].append((text or None, kind or None, slot))
                slot += 10 if kind else 0
    return out


def corpus(numbers: DataFrame) -> DataFrame:
    """Rows (doc_id, doc_kind, pages) of rows (n): pages of pieces (t, kind)."""
    kinds = numbers.sparkSession.createDataFrame([(k, kind, pages) for k, (kind, pages) in enumerate(zip(KINDS, _templates(), strict=True))], "k long, doc_kind string, made array<array<struct<t:string,kind:string,slot:int>>>")
    value = " ".join(f"when '{kind}' then {sql}" for kind, sql in VALUES.items())
    rows = numbers.select(F.col("n").cast("long").alias("n")).withColumn("k", F.col("n") % len(KINDS)).join(F.broadcast(kinds), "k")
    return rows.select(F.col("n").alias("doc_id"), "doc_kind", F.expr(f"transform(made, p -> transform(p, x -> named_struct('t', case x.kind {value} else x.t end, 'kind', x.kind)))").alias("pages"))


def _text(page: Column) -> Column:
    return F.array_join(F.transform(page, lambda x: x["t"]), "")


def documents(made: DataFrame, *keep: str) -> DataFrame:
    """Rows (doc_id, doc_kind, *keep, text) of a corpus."""
    return made.select("doc_id", "doc_kind", *keep, F.array_join(F.transform("pages", _text), C.PAGE_SEPARATOR).alias("text"))


def paged(made: DataFrame) -> DataFrame:
    """Rows (doc_id, doc_kind, page, pieces, text)."""
    rows = made.select("doc_id", "doc_kind", F.posexplode("pages").alias("k", "pieces"))
    return rows.select("doc_id", "doc_kind", (F.col("k") + 1).alias("page"), "pieces", _text(F.col("pieces")).alias("text"))


KEY = "struct<kind:string,s:int,e:int>"


def page_keys(pieces: Column) -> Column:
    """The answer key of a page of pieces: an array of (kind, s, e)."""

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        end = at + F.length(x["t"])
        one = F.array(F.named_struct(F.lit("kind"), x["kind"], F.lit("s"), at, F.lit("e"), end))
        return end, F.when(x["kind"].isNull(), S.empty(f"array<{KEY}>")).otherwise(one)

    return S.scan(pieces, F.lit(0), KEY, step)


def keys(made: DataFrame) -> DataFrame:
    """Rows (doc_id, doc_kind, page, span_id, kind, s, e, text): the answer key, with offsets on the page."""
    found = paged(made).withColumn("keys", page_keys(F.col("pieces")))
    rows = found.select("doc_id", "doc_kind", "page", "text", F.posexplode("keys").alias("k", "x"))
    span_id = F.concat_ws("-", F.col("doc_id").cast("string"), F.col("page").cast("string"), F.col("k").cast("string"))
    return rows.select("doc_id", "doc_kind", "page", span_id.alias("span_id"), "x.kind", "x.s", "x.e", "text")


def _boxed(line: Column, a: Column, b: Column) -> list[Column]:
    y = TOP + LINE * line
    return [(LEFT + WIDTH * a).alias("x0"), y.alias("y0"), (LEFT + WIDTH * b).alias("x1"), (y + HEIGHT).alias("y1")]


def words(made: DataFrame) -> DataFrame:
    """Rows (doc_id, page, block_no, line_no, word_no, text, box): the words of the pages where they are laid out."""
    lines = paged(made).select("doc_id", "page", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    found = lines.select("doc_id", "page", "line_no", "line", F.posexplode(S.spans(F.col("line"), "[^ ]+")).alias("word_no", "x"))
    return found.select("doc_id", "page", F.lit(0).alias("block_no"), "line_no", "word_no", S.value(F.col("line"), F.col("x")).alias("text"), *_boxed(F.col("line_no"), F.col("x.s"), F.col("x.e")))


def key_chars(key: DataFrame) -> DataFrame:
    """Rows (doc_id, span_id, page, i, c, box) of the characters of keys that are not blank. Where a key begins is found once for all of
    its characters."""
    value = F.substring(F.col("text"), F.col("s") + 1, F.col("e") - F.col("s"))
    begin = F.length(F.substring_index(F.substring(F.col("text"), F.lit(1), F.col("s")), "\n", -1))
    rows = key.select("doc_id", "span_id", "page", value.alias("v"), S.line_of(F.col("text"), F.col("s")).alias("first"), begin.alias("begin"))
    rows = rows.select("*", F.posexplode(F.split("v", "\n", -1)).alias("k", "part"))
    ahead = F.when(F.col("k") > 0, F.expr(r"length(substring_index(v, '\n', k)) + 1")).otherwise(0)
    rows = rows.select("doc_id", "span_id", "page", (F.col("first") + F.col("k")).alias("line"), F.when(F.col("k") == 0, F.col("begin")).otherwise(0).alias("begin"), ahead.alias("ahead"), F.posexplode(F.split("part", "")).alias("j", "c")).filter("c not in ('', ' ')")
    column = F.col("begin") + F.col("j")
    return rows.select("doc_id", "span_id", "page", (F.col("ahead") + F.col("j")).alias("i"), "c", *_boxed(F.col("line"), column, column + 1))


def page_words(text: Column) -> Column:
    """The words of a page's text where they are laid out: an array of (s, e, line, box), with offsets on the page."""

    def word(w: Column, begin: Column) -> Column:
        y = TOP + LINE * w["line"]
        sides = {"x0": LEFT + WIDTH * (w["s"] - begin), "y0": y, "x1": LEFT + WIDTH * (w["e"] - begin), "y1": y + HEIGHT}
        return F.named_struct(*[x for name in ("s", "e", "line") for x in (F.lit(name), w[name])], *[x for name, v in sides.items() for x in (F.lit(name), v)])

    lines = F.concat(F.array(F.lit(0)), F.transform(S.spans(text, "\n"), lambda x: x["e"]))
    found = S.spans(text, "[^ \n]+", lines=True)
    return S.once(lines, lambda begins: F.transform(found, lambda w: word(w, F.element_at(begins, w["line"] + 1))))


def key_centres(text: Column, s: Column, e: Column) -> Column:
    """The centres (c, cx, cy) of the characters of a key that are not blank, on a page's text. Where the key begins is found once."""
    begin = F.length(F.substring_index(F.substring(text, F.lit(1), s), "\n", -1))

    def parts(at: Column) -> Column:
        def centre(c: Column, j: Column, left: Column, y: Column) -> Column:
            return F.named_struct(F.lit("c"), c, F.lit("cx"), left + WIDTH * j, F.lit("cy"), y)

        def line(part: Column, k: Column) -> Column:
            corner = F.named_struct(F.lit("x"), LEFT + WIDTH * (F.when(k == 0, at["begin"]).otherwise(0) + 0.5), F.lit("y"), TOP + LINE * (at["line"] + k) + HEIGHT / 2)
            return S.once(corner, lambda p: F.transform(F.split(part, ""), lambda c, j: centre(c, j, p["x"], p["y"])))

        return F.flatten(F.transform(F.split(F.substring(text, s + 1, e - s), "\n", -1), line))

    found = S.once(F.named_struct(F.lit("begin"), begin, F.lit("line"), S.line_of(text, s)), parts)
    return F.filter(found, lambda x: (x["c"] != "") & (x["c"] != " "))
