"""Secret scan: fixed patterns, and a randomness test battery for what they do not name.

Patterns give the base spans. Beside them, every run of ``RUN`` or more token characters
that touches no base span is a candidate. It is read in several ways: whole, each part
between ``/``, ``=`` and ``+``, and of each of these also the characters without the
separators ``-`` and ``_``, and those after leading words (a prefix such as ``sk_live_``).
The encoding of a reading is the smallest alphabet that holds its characters. Under the
hypothesis that it is random in that encoding three tests give deviations: chi-squared
uniformity over the alphabet, runs above and below the alphabet's middle, and serial
correlation of neighbours. A candidate of which every reading is rejected by a test is no
secret; else its evidence is that of the best reading left, less for the number of readings.

Short tokens pass such tests by chance, so evidence is weighed by length: under the
hypothesis of ordinary writing (coincidences as frequent as in text, few changes between
letters, capitals and digits) the number of coincidences and of class changes have known
means and deviations at each length. Their combined tail probability goes through a
Benjamini-Hochberg procedure over the candidates of all documents at rate ``RATE``. The
procedure needs only the counts of probabilities, rounded up to 1/20 of a decade: a table
of at most ``BINS`` rows.

Everything is DataFrame functions over the row; texts are read once and never shuffled.

Defined cases: a null text has no spans; repeated and null ids give a row each; texts of
any length are scanned whole; an empty table gives an empty result; other columns are not
read (``redact`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vouchlake.llm.components import stored

#: Kind, pattern, least length of the match (or of group 2 for assign).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"

KINDS = ("assign", "access", "hex", "random")
RUN = 20
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{RUN},}}"
RATE = 0.01
BINS = 800
#: Deviations beyond which a test rejects randomness.
REJECT = 3.0
#: Ordinary writing: chance that two letters coincide, that three do, and of a change of character class.
PAIR, TRIPLE, CHANGE = 0.0667, 0.0056, 0.05

SPAN = "array<struct<start:int,kind:int,end:int>>"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
#: Alphabets by inferred encoding, smallest first: name, pattern of the whole reading, letters in order.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
ENCODINGS = (
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef"),
    ("upper", "^[A-Z]+$", LETTERS),
    ("lower", "^[a-z]+$", LETTERS.lower()),
    ("base32", "^[A-Z2-7]+$", LETTERS + "234567"),
    ("base32_lower", "^[a-z2-7]+$", LETTERS.lower() + "234567"),
    ("base32hex", "^[0-9A-V]+$", DIGITS + LETTERS[:22]),
    ("base32hex_lower", "^[0-9a-v]+$", DIGITS + LETTERS[:22].lower()),
    ("crockford", "^[0-9A-HJKMNP-TV-Z]+$", CROCKFORD),
    ("crockford_lower", "^[0-9a-hjkmnp-tv-z]+$", CROCKFORD.lower()),
    ("base36", "^[A-Z0-9]+$", LETTERS + DIGITS),
    ("base36_lower", "^[a-z0-9]+$", LETTERS.lower() + DIGITS),
    ("base58", "^[1-9A-HJ-NP-Za-km-z]+$", "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz123456789"),
    ("alnum", "^[A-Za-z0-9]+$", LETTERS + LETTERS.lower() + DIGITS),
    ("base64", "^.*$", LETTERS + LETTERS.lower() + DIGITS + "+/"),
)
#: Least characters of a reading, and a leading word of a prefix.
READING = 16
WORD = "^[A-Za-z]*[0-9]{0,2}$"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _pieces(items: Column, use) -> Column:
    """``use(piece, first index)`` of each piece of about the square root of the items; what grows with a
    piece's square then grows with the power 1.5 of the items."""
    size = F.size(items)
    width = F.greatest(F.ceil(F.sqrt(size)), F.lit(1)).cast("int")
    heads = F.when(size > 0, F.sequence(F.lit(0), size - 1, width)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(heads, lambda h: use(F.slice(items, h + 1, width), h))


def _starts(steps: Column) -> Column:
    """Where each match begins: gaps and lengths before it added up, within pieces and over them."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("starts"))
    step = lambda s, x: F.struct((s["at"] + x["g"] + x["n"]).alias("at"), F.concat(s["starts"], F.array(s["at"] + x["g"])).alias("starts"))
    before = lambda parts, j: F.aggregate(F.slice(parts, 1, j), F.lit(0), lambda s, x: s + x["at"])
    whole = lambda parts: F.transform(parts, lambda p, j: _let(before(parts, j), lambda at: F.transform(p["starts"], lambda x: x + at)))
    return _let(_pieces(steps, lambda piece, _: F.aggregate(piece, start, step)), lambda parts: F.flatten(whole(parts)))


def _places(text: Column, pattern: str, kind: int) -> Column:
    """Matches as (start, kind, end, value): their lengths and those of the gaps between them, added up."""
    def placed(match):
        sizes = F.transform(match, F.length)
        gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), 1, F.size(match))
        steps = F.zip_with(gaps, sizes, lambda g, n: F.struct(g.alias("g"), n.alias("n")))
        return F.arrays_zip(_let(steps, _starts).alias("start"), match.alias("value"))

    found = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["value"])).alias("end"), x["value"].alias("value")))


def _when_found(text: Column, pattern: str, value: Column) -> Column:
    """The costly expression only where the pattern occurs."""
    return F.when(text.rlike(pattern), value)


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def base_spans(text: Column) -> Column:
    none = F.expr(f"cast(array() as {SPAN})")
    groups = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assign = F.zip_with(_places(text, ASSIGN, 0), groups, lambda x, g: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.length(g).alias("n")))
    assign = _bare(F.filter(assign, lambda x: x["n"] >= ASSIGN_LEAST))
    parts = [_when_found(text, ASSIGN, assign), *[_when_found(text, p, _bare(_places(text, p, k))) for k, p in ((1, ACCESS), (2, HEX))]]
    return F.array_sort(F.concat(*[F.coalesce(p, none) for p in parts]))


def _tail(z: Column) -> Column:
    """-log10 of the upper normal tail, closed form by the Mills ratio."""
    a = F.abs(z)
    upper = -(a * a) / 2 + F.log(F.lit(0.7978845608028654) / (a + F.sqrt(a * a + 2.5464790894703255)))
    return F.when(z >= 0, -upper).otherwise(-F.log1p(-F.exp(upper))) / F.lit(2.302585092994046)


def _measures(token: Column, name: Column, alphabet: Column) -> Column:
    """Deviations of the battery under randomness and the evidence against ordinary writing."""
    n = F.length(token).cast("double")
    size = F.length(alphabet).cast("double")
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    squares = F.aggregate(F.transform(F.array_distinct(chars), lambda c: n - F.length(F.replace(token, c, F.lit("")))), F.lit(0.0), lambda s, c: s + c * c)
    return _let(squares, lambda q: _let(_sides(token, alphabet), lambda sides: _battery(token, name, alphabet, n, size, q, sides, _serial(chars, n))))


def _sides(token: Column, alphabet: Column) -> Column:
    half = (F.length(alphabet) / 2).cast("int")
    sides = F.call_function("translate", token, alphabet, F.concat(F.repeat(F.lit("0"), half), F.repeat(F.lit("1"), F.length(alphabet) - half)))
    return F.regexp_replace(sides, "[^01]", "1")


def _serial(chars: Column, n: Column) -> Column:
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)

    def correlated(away):
        square = total(F.transform(away, lambda x: x * x))
        product = total(F.zip_with(F.slice(away, 1, F.size(away) - 1), F.slice(away, 2, F.size(away)), lambda x, y: x * y))
        return _let(square, lambda q: F.when(q > 0, product / q * F.sqrt(n)).otherwise(F.lit(99.0)))

    codes = F.transform(chars, lambda c: F.ascii(c).cast("double"))
    return _let(codes, lambda cs: _let(total(cs) / n, lambda mean: _let(F.transform(cs, lambda x: x - mean), correlated)))


def _battery(token: Column, name: Column, alphabet: Column, n: Column, size: Column, squares: Column, sides: Column, serial: Column) -> Column:
    # Chi-squared by the cube root of Wilson and Hilferty.
    free = size - 1
    uniform = (F.pow(F.greatest(size * squares / n - n, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    times = lambda text, part: (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)
    ones = times(sides, "1")
    runs = 1 + times(sides, "01") + times(sides, "10")
    expected = 1 + 2 * ones * (n - ones) / n
    spread = (expected - 1) * (expected - 2) / (n - 1)
    run_z = F.when(spread > 0, (runs - expected) / F.sqrt(spread)).otherwise(F.lit(99.0))
    passed = (uniform <= REJECT) & (F.abs(run_z) <= REJECT) & (F.abs(serial) <= REJECT)
    # Ordinary writing: coincidences (squares - n) / (n (n - 1)) and class changes.
    coincide = (squares - n) / (n * (n - 1))
    coincide_z = (PAIR - coincide) / F.sqrt((2 * PAIR * (1 - PAIR) + 4 * (n - 2) * (TRIPLE - PAIR * PAIR)) / (n * (n - 1)))
    classes = F.call_function("translate", token, F.lit(LETTERS + LETTERS.lower() + DIGITS), F.lit("U" * 26 + "l" * 26 + "9" * 10))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(classes, "U+", "U"), "l+", "l"), "9+", "9")
    change_z = (F.length(classes) - 1 - (n - 1) * CHANGE) / F.sqrt((n - 1) * CHANGE * (1 - CHANGE))
    evidence = _tail((coincide_z + change_z) / F.sqrt(F.lit(2.0)))
    return F.struct(passed.alias("passed"), evidence.alias("evidence"), name.alias("encoding"))


def _encoding(token: Column) -> tuple[Column, Column]:
    name = alphabet = None
    for label, pattern, letters in reversed(ENCODINGS):
        fits = token.rlike(pattern)
        name = F.lit(label) if name is None else F.when(fits, label).otherwise(name)
        alphabet = F.lit(letters) if alphabet is None else F.when(fits, letters).otherwise(alphabet)
    return name, alphabet


def _readings(token: Column) -> Column:
    """Texts that may hold the random part of a run, each once: see the module's text."""
    whole = F.rtrim(token, F.lit("="))
    bodies = F.concat(F.array(whole), F.split(whole, "[/=+]+"))

    def read(body):
        parts = F.split(body, "[-_]+")
        first = F.array_position(F.transform(parts, lambda p: ~p.rlike(WORD)), F.lit(True)).cast("int")
        behind = F.when(first > 0, F.slice(parts, first, F.size(parts))).otherwise(F.slice(parts, -1, 1))
        return F.array(body, F.array_join(parts, ""), F.array_join(behind, ""))

    return F.array_distinct(F.filter(F.flatten(F.transform(bodies, read)), lambda r: F.length(r) >= READING))


def _judged(token: Column) -> Column:
    """The best reading: one that passed before others, then by evidence."""
    def best(readings):
        named = F.transform(readings, lambda r: F.struct(r.alias("r"), *[c.alias(k) for k, c in zip(("name", "alphabet"), _encoding(r), strict=True)]))
        # One of several readings is best by chance more often: its probability counts once for each.
        paid = F.log10(F.size(readings).cast("double"))
        measured = F.transform(named, lambda x: _measures(x["r"], x["name"], x["alphabet"]))
        return F.array_max(F.transform(measured, lambda m: F.struct(m["passed"].alias("passed"), (m["evidence"] - paid).alias("evidence"), m["encoding"].alias("encoding"))))

    return _let(_readings(token), best)


def _candidates(text: Column, base: Column) -> Column:
    found = _when_found(text, CANDIDATE, _places(text, CANDIDATE, 3))
    meet = lambda x, y: (x["start"] < y["end"]) & (y["start"] < x["end"])

    def apart(piece, _):
        reach = F.struct(F.element_at(piece, 1)["start"].alias("start"), F.element_at(piece, -1)["end"].alias("end"))
        near = _let(reach, lambda r: F.filter(base, lambda b: meet(b, r)))
        return _let(near, lambda bs: F.filter(piece, lambda c: ~F.exists(bs, lambda b: meet(b, c))))

    free = _let(found, lambda cs: F.flatten(_pieces(cs, apart)))

    def measured(c):
        return F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), _judged(c["value"]).alias("m"))

    def binned(c):
        n = F.floor(F.greatest(F.least(c["m"]["evidence"] * 20, F.lit(float(BINS))), F.lit(0.0))).cast("int")
        passed = F.coalesce(c["m"]["passed"], F.lit(False))
        return F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), passed.alias("passed"), F.coalesce(n, F.lit(0)).alias("bin"), c["m"]["encoding"].alias("encoding"))

    return F.coalesce(F.transform(F.transform(free, measured), binned), F.expr("cast(array() as array<struct<start:int,kind:int,end:int,passed:boolean,bin:int,encoding:string>>)"))


def _least_bin(bins: DataFrame) -> int:
    """Benjamini-Hochberg over binned probabilities: the least bin that is still rejected."""
    counts = {r["bin"]: r["n"] for r in bins.filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n")).collect()}
    total, above, least = sum(counts.values()), 0, BINS + 1
    for b in sorted(counts, reverse=True):
        above += counts[b]
        if 10 ** (-b / 20) <= RATE * above / total:
            least = b
    return least


def _scanned(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Rows with ``_base`` and ``_more``; a one-row generator keeps each from being computed twice."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*keep, F.explode(F.array(F.struct(text.alias("t"), base_spans(text).alias("b")))).alias("_s"))
    return rows.select(*keep, F.col("_s.b").alias("_base"), F.explode(F.array(_candidates(F.col("_s.t"), F.col("_s.b")))).alias("_more"))


def _decided(rows: DataFrame) -> DataFrame:
    """Add ``spans``: base spans and those candidates that the battery and the procedure leave."""
    least = _least_bin(rows.select(F.explode(F.col("_more.bin")).alias("bin")))
    added = _bare(F.filter("_more", lambda c: c["passed"] & (c["bin"] >= least)))
    return rows.withColumn("spans", F.array_sort(F.concat("_base", added))).drop("_more")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) of each document: arrays of (start, kind number, end) by start, then kind."""
    rows, _ = stored(_scanned(docs, ["doc_id"]), "spans")
    return _decided(rows).withColumnRenamed("_base", "base")


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))))


def _cut(text: Column, spans: Column, piece: Column, head: Column, mark: str) -> Column:
    """The text from this piece's first span (from its start, for the first piece) up to the next piece's."""
    low = F.when(head > 0, F.element_at(piece, 1)["start"]).otherwise(F.lit(0))
    high = F.coalesce(F.get(spans, head + F.size(piece))["start"], F.length(text))
    # Spans of earlier pieces may reach into this one.
    done = F.coalesce(F.array_max(F.transform(F.slice(spans, 1, head), lambda x: x["end"])), F.lit(0))
    frame = F.struct(low.alias("low"), high.alias("high"), F.greatest(low, done).alias("at"), text.substr(low + 1, high - low).alias("part"))

    def inside(f):
        between = lambda a, b: f["part"].substr(a - f["low"] + 1, F.greatest(b - a, F.lit(0)))
        start = F.struct(f["at"].alias("at"), F.lit("").alias("out"))
        out = lambda s, x: F.when(x["start"] >= s["at"], F.concat(s["out"], between(s["at"], x["start"]), F.lit(mark))).otherwise(s["out"])
        step = lambda s, x: F.struct(F.greatest(s["at"], x["end"]).alias("at"), out(s, x).alias("out"))
        return F.aggregate(piece, start, step, lambda s: F.concat(s["out"], between(s["at"], f["high"])))

    return _let(frame, inside)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced; overlapping spans count as one. All rows and columns stay."""
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col("text").cast("string").alias("text"))
    rows, _ = stored(_scanned(packed, ["_row", "text"]), "spans")
    rows = _decided(rows)
    cut = _let(F.col("spans"), lambda spans: F.array_join(_pieces(spans, lambda piece, h: _cut(F.col("text"), spans, piece, h, mark)), ""))
    clean = F.when(F.size("spans") > 0, cut).otherwise(F.col("text"))
    rows = rows.withColumn("_clean", F.explode(F.array(clean)))
    own = {c: F.col(f"_row.`{c}`") for c in columns} | {"text": F.col("_clean")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.size("spans") > 0, F.length("_clean").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return rows.select(*[own[c].alias(c) for c in columns])
