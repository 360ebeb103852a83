"""Surrogates for personal data, in DataFrame functions alone.

Found entities (mail addresses, phone and card numbers, IP addresses, persons after a form of address)
give way to keyed replacements of their own type and format: letters for letters, digits for digits,
separators and case where they were, a card's check digit valid where it was, a private address
private, names in their script and gender.  A replacement depends on the key and on the entity's
canonical form alone, so one entity has one replacement in all documents, however it is written there;
persons are replaced name by name, so that a family name met alone still refers to the same person.

Collision check: replacements are drawn for the distinct entities of the whole table; of entities with
equal replacements one keeps it, an entity whose replacement is a real entity keeps none, and the rest
draw again, until all differ.  Only entities travel to the check, and replacements come back as one map
per document to the documents that have an entity; other documents are never shuffled.

Nulls, empty and very long texts: a null text stays null and an empty one empty, without entities.
Texts are read whole.  Repeated rows stay and get equal texts; a null doc_id is kept.  An empty table
gives an empty result; columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import cut_lineage, written

# Forms of address by gender.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Sra", "Госпожа", "Κυρία")
# Syllables and gendered endings of made names, by script.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke la le lo ma me mo na ne no pa pe ra re ro sa se ta te to va ve vi".split(),
    "cyrillic": "ба бе бо ва ве во га го да де до ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са се та те то".split(),
    "greek": "βα βε γα γο δα δε θα θε κα κε λα λε λο μα με μο να νε νο πα πε ρα ρε ρο σα σε τα τε το".split(),
}
GIVEN_ENDING = {"latin": ("n", "lia"), "cyrillic": ("н", "лия"), "greek": ("νος", "λια")}
FAMILY_ENDING = {"latin": ("rd", "rd"), "cyrillic": ("ров", "рова"), "greek": ("ρης", "ρη")}

_NAME = r"\p{Lu}[\p{L}'-]+"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PERSON = rf"(?<!\p{{L}})(?:{'|'.join(sorted(MALE + FEMALE, key=len, reverse=True))})\.? {_NAME}(?: {_NAME}){{0,2}}"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IP = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
PHONE = r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"
KINDS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "person": PERSON}
#: A text that lacks these has no entity.
_HINT = "[0-9@]|" + "|".join(MALE + FEMALE)
MAX_DRAWS = 64


def _q(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def _scripted(table: dict[str, str]) -> str:
    """SQL picking by the script of ``canon``."""
    return f"CASE WHEN canon RLIKE '\\\\p{{IsCyrillic}}' THEN {table['cyrillic']} WHEN canon RLIKE '\\\\p{{IsGreek}}' THEN {table['greek']} ELSE {table['latin']} END"


_ANY = "|".join(f"(?:{p})" for p in KINDS.values())
_CHARS = "regexp_extract_all({0}, '(?s).', 0)"
_DIGITS = "regexp_replace({0}, '[^0-9]', '')"
_FEMALE_SQL = f"rlike({{0}}, {_q('^(?:' + '|'.join(sorted(FEMALE, key=len, reverse=True)) + ')[. ]')})"
#: Number from the keyed stream for place i.
_AT = "CAST(conv(substr(stream, 2 * ({0}) + 1, 2), 16, 10) AS int)"


def _kind(hit: str) -> str:
    whole = lambda k: _q(f"^(?:{KINDS[k]})$")
    cases = " ".join(f"WHEN {hit} RLIKE {whole(k)} THEN '{k}'" for k in ("email", "ip", "person", "card"))
    return f"CASE {cases} ELSE 'phone' END"


def _atoms(kind: str, hit: str) -> str:
    """SQL for the entities a hit names: kind and canonical form."""
    gender = f"IF({_FEMALE_SQL.format(hit)}, 'f', 'm')"
    family = f"IF({gender} = 'f' AND n RLIKE '\\\\p{{IsCyrillic}}', regexp_replace(lower(n), 'а$', ''), lower(n))"
    names = f"""transform(slice(split({hit}, ' '), 2, size(split({hit}, ' ')) - 1), (n, i) ->
        IF(i = size(split({hit}, ' ')) - 2, struct('family' AS kind, {family} AS canon), struct(concat('given_', {gender}) AS kind, lower(n) AS canon)))"""
    canon = f"CASE {kind} WHEN 'email' THEN lower({hit}) WHEN 'ip' THEN {hit} ELSE {_DIGITS.format(hit)} END"
    return f"IF({kind} = 'person', {names}, array(struct({kind} AS kind, {canon} AS canon)))"


def _luhn(digits: str) -> str:
    """SQL for the sum of a card number's digits, every second from the right doubled, less nines."""
    d = f"CAST(substr({digits}, i, 1) AS int)"
    return f"""aggregate(sequence(1, length({digits})), 0, (a, i) -> a + IF((length({digits}) - i) % 2 = 0, {d}, IF({d} > 4, 2 * {d} - 9, 2 * {d})))"""


def _draw() -> dict[str, str]:
    """SQL columns, one on the other, that end in ``surrogate`` for kind, canon and draw."""
    letter = f"char(97 + {_AT.format('i')} % 26)"
    masked = f"array_join(transform({_CHARS.format('body')}, (c, i) -> CASE WHEN c RLIKE '[0-9]' THEN CAST({_AT.format('i')} % 10 AS string) WHEN c RLIKE '[a-z]' THEN {letter} ELSE c END), '')"
    digits = f"concat(substr(canon, 1, 1), array_join(transform(sequence(1, greatest(length(canon) - 1, 1)), i -> CAST({_AT.format('i')} % 10 AS string)), ''))"
    fixed = f"IF(kind = 'card' AND {_luhn('canon')} % 10 = 0, concat(substr(plain, 1, length(plain) - 1), CAST((10 - {_luhn('zeroed')} % 10) % 10 AS string)), plain)"
    public = f"concat_ws('.', 1 + {_AT.format(0)} % 9 + 10 * ({_AT.format(4)} % 20) + 11, {_AT.format(1)}, {_AT.format(2)}, {_AT.format(3)})"
    ip = f"CASE WHEN canon LIKE '10.%' THEN concat_ws('.', 10, {_AT.format(1)}, {_AT.format(2)}, {_AT.format(3)}) WHEN canon LIKE '192.168.%' THEN concat_ws('.', 192, 168, {_AT.format(2)}, {_AT.format(3)}) ELSE {public} END"
    syllables = _scripted({s: _array(w) for s, w in SYLLABLES.items()})
    stem = f"array_join(transform(sequence(0, 2 + draw), i -> element_at({syllables}, 1 + {_AT.format('i')} % size({syllables}))), '')"
    ending = {g: _scripted({s: f"'{e[n]}'" for s, e in GIVEN_ENDING.items()}) for n, g in enumerate("mf")}
    return {
        "stream": "array_join(transform(sequence(0, CAST(length(canon) / 32 AS int) + 2), b -> sha2(concat_ws('|', secret, kind, draw, b, canon), 256)), '')",
        "tail": "IF(kind = 'email', regexp_extract(canon, '\\\\.[^.]*$', 0), '')",
        "body": "substr(canon, 1, length(canon) - length(tail))",
        "plain": f"CASE WHEN kind IN ('card', 'phone') THEN {digits} END",
        "zeroed": "concat(substr(plain, 1, length(plain) - 1), '0')",
        "surrogate": f"""CASE WHEN kind = 'email' THEN concat({masked}, tail) WHEN kind = 'ip' THEN {ip} WHEN kind IN ('card', 'phone') THEN {fixed}
            WHEN kind = 'family' THEN {stem} WHEN kind = 'given_f' THEN concat({stem}, {ending['f']}) ELSE concat({stem}, {ending['m']}) END""",
    }


def _drawn(entities: DataFrame, key: str) -> DataFrame:
    """``kind``, ``canon``, ``draw`` and the ``surrogate`` of that draw."""
    made = entities.select("kind", "canon", "draw", F.lit(key).alias("secret"))
    for name, sql in _draw().items():
        made = made.withColumn(name, F.expr(sql))
    return made.select("kind", "canon", "draw", "surrogate")


def replacements(entities: DataFrame, key: str) -> DataFrame:
    """``kind``, ``canon``, ``surrogate`` for distinct ``entities``; within a kind all surrogates differ and none is an entity."""
    real = entities.select("kind", F.col("canon").alias("surrogate"))
    settled, waiting, draw = None, entities, 0
    while True:
        drawn = _drawn(waiting.withColumn("draw", F.lit(draw)), key)
        free = drawn.join(real, ["kind", "surrogate"], "left_anti")
        if settled is not None:
            free = free.join(settled, ["kind", "surrogate"], "left_anti")
        won = free.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon")).select("kind", "canon", "surrogate")
        settled = cut_lineage(won if settled is None else settled.unionByName(won))
        waiting = cut_lineage(waiting.join(settled, ["kind", "canon"], "left_anti"))
        if waiting.isEmpty():
            return settled
        if (draw := draw + 1) >= MAX_DRAWS:
            raise RuntimeError("too many entities of one kind for as many different replacements")


def _rendered() -> str:
    """SQL for the replacement of hit ``h``, given the document's map ``known``."""
    hit = "h.hit"
    get = lambda kind, canon: f"known[concat({kind}, ':', {canon})]"
    cased = lambda new, old: f"IF({old} = upper({old}) AND length({old}) > 1, upper({new}), initcap({new}))"
    mail = f"array_join(zip_with({_CHARS.format(get(_q('email'), f'lower({hit})'))}, {_CHARS.format(hit)}, (n, o) -> IF(o = upper(o), upper(n), n)), '')"
    number = f"""aggregate({_CHARS.format(hit)}, struct(1 AS at, '' AS done), (a, c) -> IF(c RLIKE '[0-9]',
        struct(a.at + 1 AS at, concat(a.done, substr({get('h.kind', _DIGITS.format(hit))}, a.at, 1)) AS done), struct(a.at AS at, concat(a.done, c) AS done)), a -> a.done)"""
    gender = f"IF({_FEMALE_SQL.format(hit)}, 'f', 'm')"
    stem = f"IF({gender} = 'f' AND n RLIKE '\\\\p{{IsCyrillic}}', regexp_replace(lower(n), 'а$', ''), lower(n))"
    ending = {s: f"IF({gender} = 'f', '{e[1]}', '{e[0]}')" for s, e in FAMILY_ENDING.items()}
    family = f"concat({get(_q('family'), stem)}, {_scripted(ending).replace('canon', 'n')})"
    last = f"size(split({hit}, ' ')) - 1"
    person = f"""array_join(transform(split({hit}, ' '), (n, i) -> CASE WHEN i = 0 THEN n WHEN i = {last} THEN {cased(family, 'n')}
        ELSE {cased(get(f"concat('given_', {gender})", 'lower(n)'), 'n')} END), ' ')"""
    return f"CASE h.kind WHEN 'email' THEN {mail} WHEN 'ip' THEN {get(_q('ip'), hit)} WHEN 'person' THEN {person} ELSE {number} END"


def replaced(docs: DataFrame, key: str = "surrogates") -> DataFrame:
    """``docs`` with the entities in ``text`` replaced, and ``__hits``, how many of each kind there were (a map)."""
    rest = [c for c in docs.columns if c != "text"]
    held = docs.select(F.struct(*[F.col(c) for c in rest]).alias("__row"), F.col("text").cast("string").alias("t")) if rest else docs.select(F.lit(0).alias("__row"), F.col("text").alias("t"))
    any_hit = f"CASE WHEN t RLIKE {_q(_HINT)} THEN regexp_extract_all(t, {_q(_ANY)}, 0) ELSE CAST(array() AS array<string>) END"
    split = held.withColumn("hits", F.coalesce(F.expr(any_hit), F.expr("CAST(array() AS array<string>)")))
    without = split.where("size(hits) = 0").select("__row", F.col("t").alias("text"), F.expr("CAST(map() AS map<string, long>)").alias("__hits"))

    found = written(
        split.where("size(hits) > 0").selectExpr(
            "__row", "concat(sha2(t, 256), sha2(to_json(struct(__row)), 256)) AS place", f"split(t, {_q(_ANY)}, -1) AS gaps",
            f"transform(hits, h -> struct({_kind('h')} AS kind, h AS hit)) AS hits",
        )
    )
    atoms = found.select("place", F.explode(F.array_distinct(F.flatten(F.expr(f"transform(hits, h -> {_atoms('h.kind', 'h.hit')})")))).alias("a")).select("place", "a.*")
    chosen = replacements(cut_lineage(atoms.select("kind", "canon").distinct()), key)
    maps = atoms.distinct().join(chosen, ["kind", "canon"]).groupBy("place").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "kind", "canon"), "surrogate"))).alias("known"))
    done = found.join(maps, "place").selectExpr(
        "__row", f"concat(array_join(zip_with(slice(gaps, 1, size(hits)), transform(hits, h -> {_rendered()}), (g, n) -> concat(g, n)), ''), element_at(gaps, -1)) AS text",
        "aggregate(hits, CAST(map() AS map<string, long>), (m, h) -> map_concat(map_filter(m, (k, v) -> k <> h.kind), map(h.kind, coalesce(m[h.kind], 0L) + 1L))) AS __hits",
    )
    both = without.unionByName(done)
    return both.select(*[F.col("text") if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns], "__hits")


def op9(docs: DataFrame) -> DataFrame:
    """Every document with its replaced text and the number of entities of each kind."""
    counts = [F.coalesce(F.col("__hits")[k], F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    return replaced(docs.select("doc_id", "text")).select("doc_id", "text", *counts)
