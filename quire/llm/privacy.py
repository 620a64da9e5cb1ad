"""Personal data and secrets replaced by keyed surrogates, with Spark SQL functions only.

Found are e-mail addresses, telephone numbers, IPv4 addresses, card and account numbers, US social security numbers, quoted
or well-known credentials, and names after a form of address. A surrogate has the type, format, letter case and script of
what it replaces, and a name's gender follows the form of address before it. It depends on the key and on the entity's
normal form alone, so an entity has the same surrogate wherever it stands (coreference).

A run of 13 to 18 digits, or of four by four, is a card number only if its check digit (Luhn) is right; others stay as they are, unless
a credential's name and quotes stand around them.

Digit formats, card numbers, account numbers and IPv4 addresses are permuted by a keyed Feistel network, so different ones stay
different by construction. A card number keeps its first digit and gets the check digit that belongs to it, an account number (IBAN)
with right check digits keeps its country and gets right ones.
Surrogates of the other types are drawn from a keyed digest; a check over all distinct entities of the corpus makes sure that
no two share a surrogate and none is an entity that occurs. If any e-mail or name does, surrogates of these types become longer;
entities of any type that still collide are drawn again one by one (a salt per entity, kept in a map), and a salt beyond AGAIN adds
letters, so that this ends. The check shuffles distinct entities only; texts are never shuffled.

A name is the same with any form of address before it, and its family name too; a given name follows the gender of the form of
address. Names in other scripts than Latin are drawn letter by letter in their own.

The key comes from the caller and has no default. Digits keep their number and format. As permutations they need no check: two
of one format never share a surrogate, though a surrogate can be a number that occurs elsewhere.

Null and empty texts stay as they are; ties and repeated rows get the same surrogates; an empty table gives an empty one; all
other columns, whatever their names, are passed on. A very long text is replaced whole; its pattern has no part that recurs on
itself, so its length doesn't deepen the stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm._core import written

#: Salts that draw a secret again at its own length; each further one makes it a letter longer. Most letters that names and e-mails grow.
AGAIN, WIDEST = 8, 8
# Forms of address by gender, given names by gender, syllables of family names.
_HE = ["Mr", "Herr", "Monsieur", "Señor", "Sir"]
_SHE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Lady"]
_ANY = ["Dr", "Prof"]
_GIVEN = {
    "he": ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Louis", "Martin", "Oscar", "Paul", "Victor"],
    "she": ["Anna", "Bella", "Clara", "Diana", "Elena", "Frida", "Greta", "Helena", "Irene", "Julia", "Laura", "Maria", "Nora", "Olga", "Paula", "Vera"],
    "any": ["Alex", "Andrea", "Ariel", "Charlie", "Dominique", "Eden", "Jo", "Kim", "Luca", "Noel", "Pat", "Robin", "Sam", "Sasha", "Toni", "Yael"],
}
_SYLLABLES = ["ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "go", "ha", "ka", "ke", "ko", "la", "le", "li", "lo", "ma", "me", "mo", "na", "ne", "no", "ra", "re", "ro", "sa", "se", "so", "ta", "va"]

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLE = "|".join(_HE + _SHE + _ANY)
_WORDISH = r"\p{L}\p{N}._%+\-"
_LABEL = r"\p{L}\p{N}\-"
PATTERN = "|".join([
    rf"(?<![{_WORDISH}])[{_WORDISH}]++@(?:[{_LABEL}]++\.(?=\p{{L}}{{2}}|[{_LABEL}]++\.[{_LABEL}]))++\p{{L}}{{2,}}",
    rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    r"(?<![\d+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\) ?|(?<!\d)\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d)",
    r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|ghp_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64})(?![0-9A-Za-z])",
    r"(?<=(?i:token|secret|password|passwd|api_key|apikey) ?[=:] ?[\"'])[^\"'\s]{6,200}[\"']",  # with the closing quote, which tells it from the others
    r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?\d{4}){3,6}(?: ?\d{1,3})?(?![0-9A-Za-z])",
    r"(?<!\d)(?:\d{13,18}|\d{4}(?:[ \-]\d{4}){3})(?!\d)",
    r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?(?!\p{{L}})",
])
#: Any text with an entity has one of these.
_HINT = rf"[@0-9]|(?:{_TITLE})\.? \p{{Lu}}|[=:] ?[\"']"


def _text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _list(values: list[str]) -> str:
    return f"array({', '.join(map(_text, values))})"


_CARD = "^(?:[0-9]{13,18}|[0-9]{4}(?:[ -][0-9]{4}){3})$"
_ACCOUNT = "^[A-Z]{2}[0-9]{2}(?: ?[0-9]{4}){3,6}(?: ?[0-9]{1,3})?$"
_QUOTED = "[\"']$"


def _luhn(digits: str, check: bool) -> str:
    """Luhn sum of digits; without a check digit at their end, the last digit counts twice too."""
    d = f"cast(substr({digits}, -i, 1) AS INT)"
    return f"aggregate(sequence(1, length({digits})), 0, (s, i) -> s + CASE WHEN i % 2 = {0 if check else 1} THEN 2 * {d} - CASE WHEN {d} > 4 THEN 9 ELSE 0 END ELSE {d} END)"


def _rest97(country: str, digits: str, check: str) -> str:
    """What digits, the country's letters as numbers and the two check digits leave when divided by 97."""
    letters = ", ".join(f"cast(ascii(substr({country}, {j}, 1)) - 55 AS STRING)" for j in (1, 2))
    return f"aggregate(split(concat({digits}, {letters}, {check}), ''), 0, (s, c) -> (s * 10 + cast(c AS INT)) % 97)"


def _bound(value: str, name: str, body: str) -> str:
    """body with the value under a name, so that it is written and worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _bare(e: str) -> str:
    return f"regexp_replace({e}, '[^0-9]', '')"


def _kind(e: str) -> str:
    """The type of e; none if e isn't personal after all."""
    card = _bound(_bare(e), "q", f"{_luhn('q', True)} % 10 = 0")
    account = _bound(_bare(e), "q", f"{_rest97(e, 'substr(q, 3)', 'substr(q, 1, 2)')} = 1")
    return (
        f"CASE WHEN {e} RLIKE {_text(_QUOTED)} THEN 'secret' WHEN {e} RLIKE {_text(_CARD)} THEN CASE WHEN {card} THEN 'card' ELSE 'none' END "
        f"WHEN {e} RLIKE {_text(_ACCOUNT)} THEN CASE WHEN {account} THEN 'account' ELSE 'secret' END WHEN {e} LIKE '%@%' AND {e} RLIKE {_text(r'^[^@]+@[^@]+$')} THEN 'email' WHEN {e} RLIKE {_text(rf'^{_OCTET}(?:[.]{_OCTET}){{3}}$')} THEN 'ip' "
        f"WHEN {e} RLIKE {_text(rf'^(?:{_TITLE})[.]? ')} THEN 'name' WHEN {e} RLIKE {_text('^[0-9 ()+.-]+$')} AND length(regexp_replace({e}, '[^0-9]', '')) BETWEEN 6 AND 36 THEN 'digits' ELSE 'secret' END"
    )


def _normal(e: str) -> str:
    """Case and forms of address don't make different entities."""
    return f"CASE WHEN {e} RLIKE {_text(_QUOTED)} THEN {e} WHEN {e} LIKE '%@%' THEN lower({e}) WHEN {e} RLIKE {_text(rf'^(?:{_TITLE})[.]? ')} THEN regexp_replace({e}, {_text(rf'^(?:{_TITLE})[.]? ')}, '') ELSE {e} END"


_CASED = [("Cyrillic", "абвгдежзиклмнопрстуфхцчшэюя"), ("Greek", "αβγδεζηθικλμνξοπρστυφχψω"), ("Armenian", "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցփքօ"), ("Latin", "àâäçèéêëîïñóôöùûü")]
_UNCASED = [("Han", "天地山水火木金土日月人口手足目耳心力田石"), ("Hiragana", "あいうえおかきくけこさしすせそたちつてと"), ("Katakana", "アイウエオカキクケコサシスセソタチツテト"), ("Hangul", "가나다라마바사아자차카타파하고노도로모보"), ("Arabic", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"), ("Hebrew", "אבגדהוזחטיכלמנסעפצקרשת"), ("Devanagari", "कखगघचछजझटठडढतथदधनपफबभमयरलवसह"), ("Thai", "กขคงจฉชซดตถทธนบปผพฟมยรลวสห")]


def _drawn(e: str, digest: str, marks: str = "false") -> str:
    """Every letter and digit of e replaced by a keyed one of the same class, case and script; where marks holds, all else but quotes too."""
    k = f"conv(substr({digest}, 1 + 2 * (i % 256), 2), 16, 10)"
    cases = [("[0-9]", "0123456789"), ("[a-f]", "abcdef"), ("[A-F]", "ABCDEF"), ("[g-z]", "ghijklmnopqrstuvwxyz"), ("[G-Z]", "GHIJKLMNOPQRSTUVWXYZ")]
    other = [x for script, low in _CASED for x in ((rf"[\p{{Is{script}}}&&\p{{Ll}}]", low), (rf"[\p{{Is{script}}}&&\p{{Lu}}]", low.upper()))]
    other += [(rf"[\p{{Is{script}}}&&\p{{L}}]", letters) for script, letters in _UNCASED] + [(r"\p{Lu}", "ÀÂÄÇÈÉÊËÎÏÑÓÔÖÙÛÜ"), (r"\p{L}", "àâäçèéêëîïñóôöùûü"), (r"\p{N}", "0123456789")]
    when = lambda pairs: " ".join(f"WHEN c RLIKE {_text(x)} THEN '{y}'" for x, y in pairs)
    letters = f"CASE {when(cases)} WHEN c RLIKE {_text(_QUOTED)} THEN '' WHEN c < '\u007f' AND NOT {marks} THEN '' {when(other)} WHEN {marks} THEN '!#$%&*+-./:;=?^_~' ELSE '' END"
    return f"array_join(transform(split({e}, ''), (c, i) -> element_at(transform(array({letters}), w -> CASE WHEN w = '' THEN c ELSE substr(w, 1 + cast({k} AS INT) % length(w), 1) END), 1)), '')"


def _permuted(digits: str, key: str) -> str:
    """A keyed bijection of digit strings of equal length (up to 36): six Feistel rounds over the two halves."""
    n = f"length({digits})"
    half = f"cast({n} / 2 AS INT)"
    start = f"named_struct('a', cast(concat('0', substr({digits}, 1, {half})) AS BIGINT), 'b', cast(substr({digits}, {half} + 1) AS BIGINT), 'm', cast(pow(10, {half}) AS BIGINT), 'w', cast(pow(10, {n} - {half}) AS BIGINT))"
    step = f"named_struct('a', s.b, 'b', pmod(s.a + pmod(xxhash64({key}, r, {n}, s.b), s.m), s.m), 'm', s.w, 'w', s.m)"
    # after an even number of rounds the halves have their first sizes again
    return f"aggregate(array(1, 2, 3, 4, 5, 6), {start}, (s, r) -> {step}, s -> concat(CASE WHEN {half} > 0 THEN lpad(cast(s.a AS STRING), {half}, '0') ELSE '' END, lpad(cast(s.b AS STRING), {n} - {half}, '0')))"


def _salted(normal: str, salt: str) -> str:
    """What an entity's surrogate depends on besides the key: its normal form, and its salt if it is over 0."""
    return f"concat({normal}, CASE WHEN {salt} > 0 THEN concat('|', {salt}) ELSE '' END)"


def _digest(id_: str, key: str) -> str:
    return "concat(" + ", ".join(f"sha2(concat({_text(key)}, '|{j}|', {id_}), 512)" for j in range(4)) + ")"


def _surrogate(e: str, kind: str, id_: str, digest: str, key: str, width: int, salt: str = "") -> str:
    """SQL for the surrogate of the entity e of the given kind, _salted() form and digest; width more letters in names and e-mails."""
    k = _text(key)
    code = f"regexp_extract({e}, {_text('^[+][0-9]{1,3}(?=[ .(-])')}, 0)"
    rest = f"substr({e}, length({code}) + 1)"
    middle = _bound("substr(q, 2, length(q) - 2)", "z", _permuted("z", f"concat({k}, substr(q, 1, 1))"))
    card = _bound(f"concat(substr(q, 1, 1), {middle})", "p", f"concat(p, cast(pmod(-{_luhn('p', False)}, 10) AS STRING))")
    inner = _bound("substr(q, 3)", "z", _permuted("z", f"concat({k}, substr({e}, 1, 2))"))
    account = _bound(inner, "p", f"concat(lpad(cast(98 - {_rest97(e, 'p', _text('00'))} AS STRING), 2, '0'), p)")
    digits = _bound(_bare(rest), "q", f"CASE {kind} WHEN 'card' THEN {card} WHEN 'account' THEN {account} ELSE {_permuted('q', k)} END")
    spread = f"aggregate(split({rest}, ''), named_struct('o', '', 'd', {digits}), (s, c) -> CASE WHEN c RLIKE '[0-9]' THEN named_struct('o', concat(s.o, substr(s.d, 1, 1)), 'd', substr(s.d, 2)) ELSE named_struct('o', concat(s.o, c), 'd', s.d) END, s -> concat({code}, s.o))"
    part = lambda j: f"cast(split({e}, '[.]')[{j}] AS BIGINT)"
    start = f"named_struct('a', {part(0)} * 256 + {part(1)}, 'b', {part(2)} * 256 + {part(3)})"
    address = f"aggregate(array(1, 2, 3, 4), {start}, (s, r) -> named_struct('a', s.b, 'b', pmod(s.a + pmod(xxhash64({k}, r, s.b), 65536L), 65536L)), s -> concat_ws('.', s.a div 256, s.a % 256, s.b div 256, s.b % 256))"
    pair = lambda j: f"cast(conv(substr(sha2(concat({k}, '|x|', {id_}), 512), {j}, 2), 16, 10) AS INT)"
    domain = "concat(" + ", ".join(f"substr('abcdefghijklmnopqrstuvwxyz', 1 + {pair(1 + 2 * j)} % 26, 1)" for j in range(8 + width)) + f", '.example.', element_at(array('com', 'org', 'net'), 1 + {pair(61)} % 3))"
    email = f"concat({_drawn(f'split(lower({e}), {_text('@')})[0]', digest)}, '@', {domain})"
    email = f"element_at(transform(array({email}), m -> CASE WHEN {e} = upper({e}) THEN upper(m) ELSE m END), 1)"
    title = f"regexp_extract({e}, {_text(rf'^(?:{_TITLE})[.]? ')}, 0)"
    which = f"CASE WHEN {title} RLIKE {_text(rf'^(?:{"|".join(_HE)})[.]? $')} THEN {_list(_GIVEN['he'])} WHEN {title} RLIKE {_text(rf'^(?:{"|".join(_SHE)})[.]? $')} THEN {_list(_GIVEN['she'])} ELSE {_list(_GIVEN['any'])} END"
    family = "initcap(concat(" + ", ".join(f"element_at({_list(_SYLLABLES)}, 1 + {pair(65 + 2 * j)} % {len(_SYLLABLES)})" for j in range(4 + width)) + "))"
    given = f"CASE WHEN size(split({e}, ' ')) > 2 THEN concat(element_at({which}, 1 + {pair(63)} % 16), ' ') ELSE '' END"
    bare = f"substr({e}, length({title}) + 1)"
    name = f"CASE WHEN {bare} RLIKE {_text('^[^ ]*[' + chr(92) + 'p{IsLatin}]')} THEN concat({given}, {family}) ELSE {_drawn(bare, digest)} END"
    secret = _drawn(e, digest, f"{salt} > 0" if salt else "false")
    if salt:
        secret = f"concat(substr({digest}, 257, greatest(0, {salt} - {AGAIN})), {secret})"
    return f"CASE {kind} WHEN 'email' THEN {email} WHEN 'ip' THEN {address} WHEN 'name' THEN concat({title}, {name}) WHEN 'none' THEN {e} ELSE CASE WHEN {kind} IN ('digits', 'card', 'account') THEN {spread} ELSE {secret} END END"


def entities(text: Column) -> Column:
    """The entities of a text, in order, a quoted one with its closing quote; null without any."""
    return F.when(text.rlike(_HINT), F.filter(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda e: F.when(e.rlike(_CARD), _is_card(e)).otherwise(True)))


def _is_card(e: Column) -> Column:
    """Whether the check digit at the end of e is right."""
    number = F.reverse(F.regexp_replace(e, "[^0-9]", ""))
    digits = F.transform(F.split(number, ""), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(digits, F.lit(0), lambda s, d: s + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def count_entities(text: str) -> Column:
    """How many entities the column text holds; 0 for null."""
    return F.coalesce(F.size(entities(F.col(text))), F.lit(0))


def _drawn_entities(docs: DataFrame) -> DataFrame:
    """The distinct entities of docs whose surrogates are drawn: normal form, kind, and one e for each gender of address."""
    title = f"regexp_extract(e, {_text(rf'^(?:{_TITLE})')}, 0)"
    gender = f"CASE WHEN {title} IN ({', '.join(map(_text, _HE))}) THEN 'he' WHEN {title} IN ({', '.join(map(_text, _SHE))}) THEN 'she' ELSE 'any' END"
    found = docs.select(F.explode(entities(F.col("text").cast("string"))).alias("e"))
    found = found.select("e", F.expr(_normal("e")).alias("normal"), F.expr(_kind("e")).alias("kind"), F.expr(gender).alias("gender"))
    return written(found.filter("kind IN ('email', 'name', 'secret')").groupBy("normal", "kind", "gender").agg(F.min("e").alias("e")))


def _colliding(found: DataFrame, key: str, width: int, salt: str = "") -> DataFrame:
    """normal and kind of the entities whose surrogate is an entity that occurs or belongs to a smaller one too."""
    found = found.withColumn("id", F.expr(_salted("normal", salt) if salt else "normal")).withColumn("digest", F.expr(_digest("id", key)))
    s = _surrogate("e", "kind", "id", "digest", key, width, salt)
    core = f"CASE kind WHEN 'email' THEN lower(s) WHEN 'name' THEN regexp_replace(s, {_text(rf'^(?:{_TITLE})[.]? ')}, '') ELSE s END"
    # written in a plan without shuffles: adaptive execution plans again after every shuffle, and the driver holds each copy of s
    drawn = written(found.withColumn("s", F.expr(s)).select("normal", "kind", F.expr(core).alias("s")))
    first = drawn.groupBy("s").agg(F.min("normal").alias("first"), F.count_distinct("normal").alias("n")).filter("n > 1").select("s", "first")
    shared = drawn.join(first, "s").filter("normal <> first").select("normal", "kind")
    occurs = drawn.join(found.select(F.col("normal").alias("s")).distinct(), "s", "left_semi").select("normal", "kind")
    return shared.union(occurs).distinct()


def without_collisions(docs: DataFrame, key: str) -> tuple[int, DataFrame | None]:
    """How many letters longer names and e-mails have to be, and normal, salt of the entities that have to be drawn again for all
    distinct entities of docs to stay apart; None without any."""
    found = _drawn_entities(docs)
    for width in range(WIDEST + 1):
        collided = written(_colliding(found, key, width))
        if collided.filter("kind <> 'secret'").isEmpty():
            break
    salts = None
    while not collided.isEmpty():
        more = collided.select("normal").distinct().withColumn("salt", F.lit(1))
        salts = more if salts is None else salts.union(more).groupBy("normal").agg(F.sum("salt").cast("int").alias("salt"))
        salts = written(salts)
        salted = found.join(salts, "normal", "left").withColumn("salt", F.coalesce("salt", F.lit(0)))
        collided = written(_colliding(salted, key, width, "salt"))
    return width, salts


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with the entities in its text replaced under a secret key; all columns stay."""
    if not key:
        raise ValueError("surrogates need a key")
    width, salts = without_collisions(docs, key)
    out = docs.withColumn("text", F.col("text").cast("string"))
    if salts is None:
        return out.withColumn("text", replaced("text", key, width))
    # one row: the few entities that collide
    held = salts.agg(F.map_from_entries(F.collect_list(F.struct("normal", "salt"))).alias("_salts"))
    return out.crossJoin(F.broadcast(held)).withColumn("text", replaced("text", key, width, "_salts")).select(*docs.columns)


def replaced(text: str, key: str, width: int = 0, salts: str = "") -> Column:
    """The column text with surrogates in the place of its entities: what stands between entities alternates with them."""
    found, gaps = f"regexp_extract_all({text}, {_text(PATTERN)}, 0)", f"split({text}, {_text(PATTERN)}, -1)"
    salt = f"coalesce(element_at({salts}, {_normal('y')}), 0)" if salts else "0"
    found = f"transform({found}, y -> named_struct('e', y, 'kind', {_kind('y')}, 'id', {_normal('y')}, 'salt', {salt}))"
    if salts:
        found = f"transform({found}, y -> named_struct('e', y.e, 'kind', y.kind, 'id', {_salted('y.id', 'y.salt')}, 'salt', y.salt))"
    found = f"transform({found}, y -> named_struct('e', y.e, 'kind', y.kind, 'id', y.id, 'salt', y.salt, 'digest', {_digest('y.id', key)}))"
    one = f"(g, x) -> concat(g, CASE WHEN x IS NULL THEN '' ELSE {_surrogate('x.e', 'x.kind', 'x.id', 'x.digest', key, width, 'x.salt' if salts else '')} END)"
    whole = f"array_join(zip_with({gaps}, {found}, {one}), '')"
    return F.expr(f"CASE WHEN {text} RLIKE {_text(_HINT)} AND {text} RLIKE {_text(PATTERN)} THEN {whole} ELSE {text} END")
