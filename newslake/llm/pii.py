"""Personal data: detection, and surrogates that keep type, gender, script and format.

The surrogate of an entity is a function of a key, the entity's type and its
canonical form, so every mention in every document gets the same one
(coreference) and no table of texts is needed. Numbers go through a keyed
permutation of the numbers of their length, letters and digits elsewhere
through a keyed stream, given names through a keyed permutation of the names
of their gender and script. A table of the distinct entities is checked for
collisions: two entities with one surrogate, or a surrogate that is itself an
entity of the corpus. Those get another attempt until none is left; documents
then use the attempts of these exceptions and attempt 0 for all others.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import os
import re
import secrets
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from newslake.llm.common import Scratch

# Given names by gender and script. A surrogate comes from the same list.
GIVEN = {
    ("male", "latin"): "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew George Peter Hans Klaus Jürgen Wolfgang Stefan Pierre Jean Michel Philippe Jacques Laurent Carlos José Juan Luis Miguel Pedro Antonio Fernando Diego Pablo".split(),
    ("female", "latin"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Donna Michelle Laura Anna Ursula Monika Petra Sabine Renate Marie Nathalie Isabelle Sylvie Catherine Françoise María Carmen Ana Isabel Dolores Pilar Teresa Rosa Lucía".split(),
    ("male", "cyrillic"): "Александр Сергей Дмитрий Андрей Алексей Иван Михаил Николай Владимир Павел Юрий Виктор".split(),
    ("female", "cyrillic"): "Елена Ольга Наталья Анна Татьяна Мария Ирина Светлана Екатерина Людмила Галина Юлия".split(),
    ("male", "greek"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Παναγιώτης Βασίλης Χρήστος".split(),
    ("female", "greek"): "Μαρία Ελένη Αικατερίνη Βασιλική Σοφία Αγγελική Γεωργία Δήμητρα".split(),
}
NAME_LIST = {n.lower(): k for k, names in GIVEN.items() for n in names}
# Titles that announce a surname.
TITLE = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra|Señor|Señora|Monsieur|Madame)\.?"

_LETTER = r"[^\W\d_]"
_BODY = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
PATTERNS = [
    ("secret", re.compile(r"""(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|private[_-]?key|credential)s?)["']?\s*(?:=|:)\s*["']?(?P<v>[A-Za-z0-9_./+\-]{8,}[A-Za-z0-9_/+=])""")),
    ("secret", re.compile(r"\b(?P<v>(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}|xox[abp]-[A-Za-z0-9-]{10,})\b")),
    ("email", re.compile(rf"(?<![A-Za-z0-9._%+-])(?P<v>[A-Za-z0-9._%+-]+@(?:{_BODY}\.)+[A-Za-z]{{2,}})")),
    ("iban", re.compile(r"\b(?P<v>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)\b")),
    ("ip", re.compile(r"(?<![\w.])(?P<v>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?![\w]|\.\d)")),
    ("phone", re.compile(r"(?<![\w+])(?P<v>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)")),
    ("ssn", re.compile(r"(?<![\w-])(?P<v>\d{3}-\d{2}-\d{4})(?![\w-])")),
    ("card", re.compile(r"(?<![\w.-])(?P<v>\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\w])")),
]
_ASCII_DIGIT, _DIGIT = re.compile(r"[0-9]"), re.compile(r"\d")
_PREFIX = re.compile(r"AKIA|ASIA|gh[pousr]_|sk-|xox[abp]-")
_KEYWORDS = ("password", "passwd", "pwd", "token", "secret", "key", "credential")
_ANY_KEYWORD = re.compile("|".join(_KEYWORDS), re.I)
_CAPITAL = r"[^\W\d_a-zß-ÿа-яα-ω]"
# Particles before a surname; they stay.
_PARTICLES = r"(?:(?:[Dd]e (?:la|las|los)|[Vv][ao]n (?:de[rn]?|het)|[Dd]e|[Dd]a|[Dd]os|[Dd]i|[Dd]el|[Dd]ella|[Vv][ao]n) )?"
# A capitalised word before another one; whether it is a given name is looked up.
_FULL = re.compile(rf"(?<!\w)(?P<given>{_CAPITAL}{_LETTER}+)(?= {_PARTICLES}(?P<family>{_CAPITAL}{_LETTER}+))")
_NAME = re.compile(rf"(?<!\w){_CAPITAL}{_LETTER}+(?!\w)")
# Capitalised words that follow a name in a title or at a slip of the pen; as names they are not looked for in the rest of the text.
_NO_NAME = frozenset("a an and are as at but by for from had has have he her his i in is it its not of on or she so that the their then there they this to was we were what when where which who will with you "
                     "der die das den dem des ein eine er es hat ich im ist mit nicht sie sind und von war wir zu "
                     "de del el en es la las le les los ne pas por que se son un una une y et est il elle nous vous il и в на не он она что это και ο η το".split())
_TITLES = ("Mr", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Mme", "Mlle", "Sr", "Señor", "Monsieur", "Madame")
_TITLED = re.compile(rf"\b{TITLE} (?:(?P<given>{_CAPITAL}{_LETTER}+) )?(?P<family>{_CAPITAL}{_LETTER}+)\b")

Span = tuple[int, int, str, str]  # start, end, type, canonical form


def _may_match(text: str) -> bool:
    """False only where no pattern can match: each needs a digit of any script,
    an @, the prefix of a key, or a keyword (whose letters have more than two
    forms outside ASCII) with = or :."""
    plain = text.isascii()
    if "@" in text or (_ASCII_DIGIT if plain else _DIGIT).search(text) or _PREFIX.search(text):
        return True
    if "=" not in text and ":" not in text:
        return False
    if not plain:
        return _ANY_KEYWORD.search(text) is not None
    low = text.lower()
    return any(k in low for k in _KEYWORDS)


def _ascii_digits(text: str) -> str:
    return text if text.isascii() else "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in text)


def canonical(kind: str, text: str) -> str:
    if kind in ("phone", "card", "ssn", "iban", "ip"):
        text = _ascii_digits(text)
    if kind in ("phone", "card", "ssn"):
        return re.sub(r"\D", "", text)
    if kind == "iban":
        return text.replace(" ", "")
    return text if kind == "secret" else text.lower()


def detect(text: str | None) -> list[Span]:
    """Entities of a whole text in order, without overlaps; where two overlap,
    the one of the earlier pattern stays. A name found once is found wherever it
    stands as a capitalised word of the text. Null and empty texts have none."""
    found: list[Span] = []
    if not text:
        return found
    if _may_match(text):  # cheap tests first
        for kind, p in PATTERNS:
            for m in p.finditer(text):
                found.append((m.start("v"), m.end("v"), kind, canonical(kind, m["v"])))
    for m in _FULL.finditer(text):
        if m["given"].lower() not in NAME_LIST:
            continue
        found.append((m.start("given"), m.end("given"), "given", m["given"].lower()))
        found.append((m.start("family"), m.end("family"), "family", m["family"].lower()))
    if any(t in text for t in _TITLES):
        for m in _TITLED.finditer(text):
            if m["given"] and m["given"].lower() in NAME_LIST:
                found.append((m.start("given"), m.end("given"), "given", m["given"].lower()))
                found.append((m.start("family"), m.end("family"), "family", m["family"].lower()))
            else:
                found.append((m.start("family") if not m["given"] else m.start("given"), m.end("given") if m["given"] else m.end("family"), "family", (m["given"] or m["family"]).lower()))
    # Further mentions of the names found, alone or beside other words.
    names: dict[str, str] = {}
    for _, _, kind, form in found:
        if kind in ("given", "family") and form not in _NO_NAME:
            names.setdefault(form, kind)
    if names:
        found += [(m.start(), m.end(), names[form], form) for m in _NAME.finditer(text) if (form := m[0].lower()) in names]
    kept: list[Span] = []  # in order
    for s in found:
        i = bisect.bisect(kept, s)
        if (not i or kept[i - 1][1] <= s[0]) and (i == len(kept) or s[1] <= kept[i][0]):
            kept.insert(i, s)
    return kept


def _stream(key: bytes, *parts: object) -> Callable[[int], int]:
    """Keyed numbers below n, one after the other."""
    state = {"i": 0, "pool": 0, "bits": 0}
    seed = "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")

    def draw(n: int) -> int:
        if state["bits"] < 64:
            d = hmac.new(key, seed + state["i"].to_bytes(4, "little"), hashlib.sha256).digest()
            state["pool"], state["bits"], state["i"] = int.from_bytes(d, "little"), 256, state["i"] + 1
        v = state["pool"] & ((1 << 48) - 1)
        state["pool"] >>= 48
        state["bits"] -= 48
        return v % n
    return draw


def permute(key: bytes, x: int, n: int, *tweak: object) -> int:
    """Keyed permutation of 0 .. n - 1: a Feistel network over the next even
    number of bits, repeated until the value is below n."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = x >> half, x & mask
        for r in range(6):
            d = hashlib.blake2b(f"{r}|{b}|{n}|{tweak}".encode(), key=key[:64], digest_size=16).digest()
            a, b = b, a ^ (int.from_bytes(d, "little") & mask)
        x = (a << half) | b
        if x < n:
            return x


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def iban_rest(form: str) -> int:
    """What is left modulo 97: 1 for an IBAN with right check digits."""
    return int("".join(str(int(c, 36)) for c in form[4:] + form[:4])) % 97


#: Ranges of addresses with a meaning of their own (private, loopback, shared, link-local, documentation, multicast, reserved); a surrogate stays in its range, or outside all of them.
ADDRESS_CLASSES = [(0x00000000, 0x00FFFFFF), (0x0A000000, 0x0AFFFFFF), (0x64400000, 0x647FFFFF), (0x7F000000, 0x7FFFFFFF), (0xA9FE0000, 0xA9FEFFFF), (0xAC100000, 0xAC1FFFFF),
                   (0xC0000200, 0xC00002FF), (0xC0A80000, 0xC0A8FFFF), (0xC6120000, 0xC613FFFF), (0xC6336400, 0xC63364FF), (0xCB007100, 0xCB0071FF), (0xE0000000, 0xEFFFFFFF), (0xF0000000, 0xFFFFFFFF)]
#: Digits of a card number that name its issuer.
ISSUER = 6


def _address_class(x: int) -> tuple[int, int] | None:
    return next((c for c in ADDRESS_CLASSES if c[0] <= x <= c[1]), None)


_SCRIPTS = [("а", "я"), ("А", "Я"), ("α", "ω"), ("Α", "Ω"), ("א", "ת"), ("ぁ", "ん"), ("ァ", "ン"), ("一", "鿋"), ("가", "힣")]


def _like(c: str, draw: Callable[[int], int], hexa: bool = False) -> str:
    """A keyed character of the same script, case and kind."""
    if c.isdigit() and c.isascii():
        return str(draw(10))
    if c.isascii() and c.isalpha():
        s = ("abcdef" if hexa else "abcdefghijklmnopqrstuvwxyz")[draw(6 if hexa else 26)]
        return s.upper() if c.isupper() else s
    for a, b in _SCRIPTS:
        if a <= c <= b:
            return chr(ord(a) + draw(ord(b) - ord(a) + 1))
    if c.isalpha():  # other Latin letters
        s = "abcdefghijklmnopqrstuvwxyz"[draw(26)]
        return s.upper() if c.isupper() else s
    return c


_ONSET, _CORE, _CODA = "b br c d dr f g gr h j k l m n p r s st t tr v w".split(), "a e i o u ai ea ou".split(), "ck ld ll lt m n nd r rd rs s son t ton".split()


def surrogate(key: bytes, kind: str, form: str, attempt: int) -> str:
    """The canonical form of the replacement of an entity's canonical form."""
    if kind in ("phone", "ssn", "card"):
        n = len(form)
        keep = max(0, n - 10) if kind == "phone" else ISSUER if kind == "card" else 0  # the country code stays, the issuer too
        if kind == "card" and luhn(form):
            body = form[:keep] + str(permute(key, int(form[keep:-1]), 10 ** (n - 1 - keep), kind, form[:keep], n, attempt)).zfill(n - 1 - keep)
            return body + next(c for c in "0123456789" if luhn(body + c))
        digits = form[keep:]
        while True:
            digits = str(permute(key, int(digits), 10 ** len(digits), kind, form[:keep], n, attempt)).zfill(len(digits))
            if kind != "card" or not luhn(form[:keep] + digits):
                return form[:keep] + digits
    if kind == "ip":
        x = 0
        for part in form.split("."):
            x = x * 256 + int(part)
        own = _address_class(x)
        if own:
            x = own[0] + permute(key, x - own[0], own[1] - own[0] + 1, kind, own, attempt)
        else:
            x = permute(key, x, 1 << 32, kind, attempt)
            while _address_class(x):
                x = permute(key, x, 1 << 32, kind, attempt)
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
    draw = _stream(key, kind, form, attempt)
    if kind == "given":
        group = NAME_LIST[form]
        names = GIVEN[group]
        low = [x.lower() for x in names]
        # The next name in a keyed order of the list: names never collide, and none stays as it is.
        order = sorted(range(len(low)), key=lambda i: hmac.new(key, f"given|{group}|{low[i]}".encode(), hashlib.sha256).digest())
        return low[order[(order.index(low.index(form)) + 1) % len(order)]]
    if kind == "family":
        if any(a <= form[0] <= b for a, b in _SCRIPTS):
            return "".join(_like(c, draw) for c in form) + "".join(_like(form[0], draw) for _ in range(attempt // 4))
        parts = 2 + attempt // 4
        return "".join(_ONSET[draw(len(_ONSET))] + _CORE[draw(len(_CORE))] for _ in range(parts)) + _CODA[draw(len(_CODA))]
    if kind == "email":
        local, _, domain = form.partition("@")
        host, _, top = domain.rpartition(".")
        more = "".join(str(draw(10)) for _ in range(attempt // 4))  # a used-up format gets longer
        return "".join(_like(c, draw) for c in local) + more + "@" + "".join(_like(c, draw) for c in host) + "." + top
    if kind == "iban":
        body = "".join(_like(c, draw) for c in form[4:])
        if iban_rest(form) == 1:
            return form[:2] + str(98 - iban_rest(form[:2] + "00" + body)).zfill(2) + body
        return form[:2] + "".join(_like(c, draw) for c in form[2:4]) + body
    hexa = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", form) is not None
    head = re.match(r"(?:AKIA|ASIA|gh[pousr]_|sk-|xox[abp]-)?", form)[0]
    return head + "".join(_like(c, draw, hexa) for c in form[len(head):])


def _digit_like(seen: str, c: str) -> str:
    """The digit ``c`` in the script of the digit ``seen``."""
    return chr(ord(seen) - unicodedata.decimal(seen) + int(c)) if c.isdecimal() and seen.isdecimal() and not seen.isascii() else c


def shaped(kind: str, seen: str, form: str) -> str:
    """A canonical replacement in the format of the mention ``seen``."""
    if kind in ("phone", "card", "ssn", "iban"):
        rest = iter(form)
        return "".join(_digit_like(c, next(rest, c)) if (c.isalnum()) else c for c in seen)
    if kind == "ip" and not seen.isascii():
        like = next(c for c in seen if c.isdecimal() and not c.isascii())
        return "".join(_digit_like(like, c) for c in form)
    if kind in ("given", "family", "email"):
        if seen.isupper() and len(seen) > 1:
            return form.upper()
        return form[:1].upper() + form[1:] if seen[:1].isupper() else form
    return form


def _distinct_entities(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            found = sorted({(kind, form) for t in b.column("text").to_pylist() for _, _, kind, form in detect(t)})
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], ["kind", "form"])
    return docs.mapInArrow(run, "kind string, form string").distinct()


def attempts(docs: DataFrame, key: bytes, scratch: Scratch, most: int = 64) -> DataFrame:
    """``(kind, form, attempt)`` of the distinct entities whose surrogate of
    attempt 0 collided. ``docs(text)``."""
    entity = scratch.save(_distinct_entities(docs))

    def make(batches):
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("kind", "form", "attempt")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("kind", "form", "attempt")), pa.array([surrogate(key, *x) for x in zip(*cols)], pa.string())], ["kind", "form", "attempt", "surrogate"])

    made = lambda df: df.select("kind", "form", "attempt").mapInArrow(make, "kind string, form string, attempt long, surrogate string")
    current = scratch.save(made(entity.withColumn("attempt", F.lit(0).cast("long"))))
    for _ in range(most):
        # The mention with the fewest attempts, then the smallest form, keeps a surrogate that several have.
        keeps = current.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "form")).alias("first")).where("n > 1").select("kind", "surrogate", F.col("first.form").alias("keeper"))
        twice = current.join(keeps, ["kind", "surrogate"]).where("form <> keeper").select("kind", "form")
        # Given names are exchanged within their list, so a surrogate there is always a name.
        real = current.where("kind <> 'given'").join(entity.select("kind", F.col("form").alias("surrogate")), ["kind", "surrogate"], "left_semi").select("kind", "form")
        again = scratch.save(twice.unionByName(real).distinct())
        if again.isEmpty():
            return current.where("attempt > 0").select("kind", "form", "attempt")
        redo = made(current.join(again, ["kind", "form"], "left_semi").withColumn("attempt", F.col("attempt") + 1))
        current = scratch.save(current.join(again, ["kind", "form"], "left_anti").unionByName(redo))
    raise ValueError(f"surrogates still collide after {most} attempts: the formats of these entities are used up")


#: Exceptions up to which their table is sent to the tasks; beyond it they are joined to the documents.
BROADCAST_EXCEPTIONS = 100_000


#: The environment variable that holds the key where the caller passes none.
KEY_VARIABLE = "NEWSLAKE_PII_KEY"


@lru_cache(maxsize=1)
def _passing_key() -> str:
    return secrets.token_hex(32)


def secret_key(key: str | None = None) -> bytes:
    """The caller's key, else that of the environment, else a random one of this
    process. None is in the source: whoever has the key can turn numbers back."""
    return hashlib.sha256((key or os.environ.get(KEY_VARIABLE) or _passing_key()).encode()).digest()


def pseudonymise(docs: DataFrame, key: str | None = None, text_col: str = "text", count_into: str = "n_entities") -> DataFrame:
    """``docs`` with the personal data of ``text_col`` replaced, and one more
    column with the number of entities replaced. ``key`` is the secret: the same
    key gives the same surrogates. Without one it is taken from the environment
    (``NEWSLAKE_PII_KEY``); if that is unset too, a random key is drawn, and
    surrogates agree among the calls of this driver process only.

    Whole texts are searched. Null texts stay null and empty ones empty, with 0
    entities; repeated rows get equal results; an empty table gives an empty
    one; all other columns stay as they are. Raises ValueError if ``docs`` has
    the new column already.
    """
    if count_into in docs.columns:
        raise ValueError(f"column {count_into} exists")
    secret = secret_key(key)
    scratch = Scratch(docs.sparkSession, "pii")
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    exceptions = scratch.save(attempts(texts, secret, scratch))
    schema = StructType([StructField(f.name, StringType() if f.name == text_col else f.dataType) for f in docs.schema.fields] + [StructField(count_into, LongType())])
    few = exceptions.count() <= BROADCAST_EXCEPTIONS
    table = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["form"]): r["attempt"] for r in exceptions.collect()} if few else {})

    columns = docs.columns
    taken = {c.lower() for c in columns}
    own_tries, text_key = (next(n for n in (f"{c}{'_' * i}" for i in range(len(taken) + 1)) if n not in taken) for c in ("attempts", "text_key"))

    def run(batches):
        known = table.value
        cached = lru_cache(1 << 16)(lambda kind, form, attempt: surrogate(secret, kind, form, attempt))
        for b in batches:
            out, count = [], []
            own = b.column(own_tries).to_pylist() if own_tries in b.schema.names else None
            for i, t in enumerate(b.column(text_col).to_pylist()):
                tries = known if own is None else {(x["kind"], x["form"]): x["attempt"] for x in own[i] or ()}
                spans = detect(t)
                if spans:
                    parts, end = [], 0
                    for lo, hi, kind, form in spans:
                        parts += [t[end:lo], shaped(kind, t[lo:hi], cached(kind, form, tries.get((kind, form), 0)))]
                        end = hi
                    t = "".join(parts) + t[end:]
                out.append(t)
                count.append(len(spans))
            cols = [pa.array(out, pa.string()) if n == text_col else b.column(n) for n in columns]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(count, pa.int64())], [*columns, count_into])

    typed = docs.withColumn(text_col, F.col(text_col).cast("string"))
    if not few:
        def mentions(batches):
            for b in batches:
                rows = sorted({(hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest(), kind, form) for t in b.column("text").to_pylist() if t for _, _, kind, form in detect(t)})
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["of", "kind", "form"])
        of_text = (texts.mapInArrow(mentions, "of string, kind string, form string").distinct().join(exceptions, ["kind", "form"])
                   .groupBy(F.col("of").alias(text_key)).agg(F.collect_list(F.struct("kind", "form", "attempt")).alias(own_tries)))
        typed = typed.withColumn(text_key, F.sha2(text_col, 256)).join(of_text, text_key, "left").select(*columns, own_tries)
    return typed.mapInArrow(run, schema)
