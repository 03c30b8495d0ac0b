"""Benchmark decontamination by template canonicalisation.

Numbers, units and names become typed placeholders, so a question whose parameters were
changed keeps its template. Windows of the templates are hashed and joined; windows on
one diagonal of a document and an item are a candidate, and the slots of each run of
them are compared: a name of the item must stand for one name of the document in most of
its places. Numbers and units are parameters of their own and may differ from place to
place. Where enough windows are equal word for word, slots do not matter. Windows that are
placeholders mostly say little as templates; they are joined by their literal words only.
A capital that starts a line may be a name in a wrapped sentence or a sentence's first
word, so its windows are joined in both readings. Items of a few words are found as whole
sentences or lines, and inside sentences if the corpus holds their words rarely. Scripts
without spaces count a character as a word. Everything is a DataFrame expression, and one
pass over a text makes the windows of all sizes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind
from .common import staged

WINDOW = 8
LEAST_WORDS = 4  # shorter items need to be rare, or whole sentences or lines
PHRASE_WORDS = 3  # items of fewer words are ordinary phrases inside a sentence
RARE_TEXTS = 10  # different texts that may hold a short item inside a sentence,
RARE_SHARE = 0.001  # or this share of all, before its words are an ordinary phrase
ENOUGH_WINDOWS = 5  # windows on one diagonal that always suffice, i.e. 12 words
MIN_COVER = 0.5  # share of a short item's windows that suffices otherwise
MIN_PLAIN = 0.5  # share of plain words below which a template says too little to be joined
BROADCAST_BYTES = 64 << 20  # benchmark windows up to which they are broadcast

# Units that may follow a number.
UNITS = (
    "mm cm km in ft mi mg g kg lb oz ml l min h hr hours minutes seconds days weeks months "
    "years dollars euros pounds cents percent meters metres miles feet inches grams "
    "kilograms liters litres degrees usd eur mph"
).split()

MARK, END = "\x01", "\x02"  # around a slot's own characters, the first with a letter for its type
LINE = "\x03"  # before a line's first word
# In this order, each within one word, so a text and its template have equal word counts.
# Each pattern begins with what is rare, as what stands before is dear to look at.
SLOTS = [
    (r"([0-9]\p{Punct}?\s\x03?)((?i:" + "|".join(UNITS) + r"))(?!\p{L})", f"$1{MARK}u$2{END}"),
    # After a line break it is a name or a sentence's first word.
    (r"\p{Lu}(?<=[^.!?:;\"'\s]\s\x03?\p{Lu})[\p{L}'’-]*", f"{MARK}p$0{END}"),
    (r"[0-9]+(?:[.,:/][0-9]+)*", f"{MARK}n$0{END}"),
]
# White space other than one plain space between words.
WIDE = r"[\s\p{Z}&&[^ ]][\s\p{Z}]*| [\s\p{Z}]+"
BREAKS = r"[\r\n\x85\u2028\u2029]+"
# Thai, Lao, Burmese, Khmer, Japanese and Chinese characters, which stand without spaces.
UNSPACED = (
    r"[\u0E00-\x{3FFFF}&&[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF"
    r"\x{20000}-\x{3FFFF}]]"
)
NO_WORD = r"[^\p{L}\p{N}\x01\x02\s]+"
# Where a sentence or line ends.
STOP = r"[.!?:;]+(?=\s|$)|[\r\n]+"


def marked_words(text: Column) -> Column:
    """The words in lower case and without punctuation, with marks around their slots."""
    text = F.translate(F.coalesce(text, F.lit("")), MARK + END + LINE, "   ")
    text = F.regexp_replace(text, UNSPACED, " $0 ")
    # Slots are told by what stands before them, so white space is made plain first.
    text = F.regexp_replace(F.regexp_replace(text, BREAKS, f" {LINE} "), WIDE, " ")
    text = F.regexp_replace(F.replace(text, F.lit(f"{LINE} "), F.lit(LINE)), f"{LINE}{LINE}+", LINE)
    for pattern, marked in SLOTS:
        text = F.regexp_replace(text, pattern, marked)
    text = F.replace(text, F.lit(f"{LINE}{MARK}p"), F.lit(f"{MARK}q"))
    text = F.lower(F.regexp_replace(text, NO_WORD, ""))
    return F.filter(F.split(text, " +"), lambda w: w != "")


def template(tokens: Column) -> Column:
    """Of ``marked_words``: a slot becomes its placeholder, a line's capital that of a name."""
    return F.transform(tokens, lambda t: F.when(
        F.contains(t, F.lit(MARK)), F.translate(
            F.regexp_replace(F.replace(t, F.lit(MARK + "q"), F.lit(MARK + "p")), "(\x01.)[^\x02]*\x02", "$1"),
            END, "",
        )
    ).otherwise(t))


def line_starts_as_words(tokens: Column) -> Column:
    """``marked_words`` in which a line's capital is no name."""
    return F.transform(tokens, lambda t: F.when(
        F.contains(t, F.lit(MARK + "q")), F.regexp_replace(t, "\x01q([^\x02]*)\x02", "$1")
    ).otherwise(t))


def words(tokens: Column) -> Column:
    """Of ``marked_words``: the words themselves, in step with ``template``."""
    return F.transform(tokens, lambda t: F.when(
        F.contains(t, F.lit(MARK)), F.regexp_replace(t, "\x01.|\x02", "")
    ).otherwise(t))


def sentences(text: Column) -> Column:
    """The words with ``END`` before, between and after sentences and lines."""
    text = F.translate(F.coalesce(text, F.lit("")), MARK + END + LINE, "   ")
    text = F.regexp_replace(text, UNSPACED, " $0 ")
    text = F.concat(F.lit(END + " "), F.regexp_replace(text, STOP, f" {END} "), F.lit(" " + END))
    text = F.regexp_replace(text, WIDE, " ")
    text = F.lower(F.regexp_replace(text, NO_WORD, ""))
    text = F.regexp_replace(text, r"\x02(?:\s+\x02)+", END)
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def rolled(tokens: Column, size: int) -> Column:
    """Hashes of all windows of ``size`` tokens, each built from two shorter windows."""

    def grow(h: Column, have: int) -> Column:
        if have == size:
            return h
        step = min(have, size - have)
        left = F.greatest(F.size(h) - step, F.lit(0))
        pairs = F.zip_with(
            F.slice(h, 1, left), F.slice(h, step + 1, left), lambda a, b: F.xxhash64(a, b)
        )
        return bind(pairs, lambda longer: grow(longer, have + step))

    return bind(F.transform(tokens, lambda t: F.xxhash64(t)), lambda h: grow(h, 1))


def _window_table(items: DataFrame, size: int) -> DataFrame:
    """Windows of the items of that size: by template unless that is thin, and by words."""
    exact = size < WINDOW
    chosen = items.filter(F.size("tokens") == size if exact else F.size("tokens") >= size)

    def plain(tokens: str) -> Column:
        ones = F.transform(tokens, lambda t: (~F.contains(t, F.lit(MARK))).cast("int"))
        return F.transform(
            F.sequence(F.lit(0), F.size(tokens) - size),
            lambda i: F.aggregate(F.slice(ones, i + 1, size), F.lit(0), lambda a, x: a + x),
        )

    rows = chosen.select(
        "item_id", F.explode(F.arrays_zip(
            rolled(F.col("tokens"), size).alias("template"), rolled(F.col("raw"), size).alias("words"),
            rolled(F.col("tokens_b"), size).alias("other"), plain("tokens").alias("plain"),
            plain("tokens_b").alias("plain_other"),
            F.sequence(F.lit(0), F.size("tokens") - size).alias("pos"),
        )).alias("w"),
    )
    rich = F.col("w.plain") >= MIN_PLAIN * size
    rich_other = F.col("w.plain_other") >= MIN_PLAIN * size
    same = F.col("w.template") == F.col("w.words")

    def row(when: Column, by: str, literal: Column) -> Column:
        return F.when(when, F.struct(
            F.col(f"w.{by}").alias("hash"), F.col("w.pos").alias("item_pos"),
            rich.alias("rich"), literal.alias("literal"),
        ))

    each = F.array(
        row(rich, "template", same), row(~rich | ~same, "words", F.lit(True)),
        row((F.col("w.other") != F.col("w.template")) & (F.col("w.other") != F.col("w.words")) & rich_other,
            "other", F.lit(False)),
    )
    return rows.select("item_id", F.lit(size).alias("size"), F.inline(F.array_compact(each)))


def _document_windows(text: Column, sizes: list[int], literal_sizes: list[int]) -> Column:
    """``(hash, pos)`` of the windows by template and, where they differ, by words.

    ``literal_sizes`` are windows by words alone. The text is made words once for all.
    """
    none = F.array().cast("array<bigint>")

    def entries(hashes: Column) -> Column:
        return F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("pos")))

    def each(first: Column, other: Column, raw: Column, size: int) -> Column:
        def unlike(hashes: Column, known: Column) -> Column:
            return F.filter(entries(hashes), lambda w: w.hash != F.get(known, w.pos))

        # An empty reading is like the first one everywhere.
        second = F.when(F.size(other) > 0, rolled(other, size)).otherwise(none)
        third = F.when(F.size(raw) > 0, rolled(raw, size)).otherwise(none)
        return bind(rolled(first, size), lambda a: F.concat(
            entries(a), unlike(second, a), unlike(third, a)
        ))

    def every(tokens: Column) -> Column:
        empty = F.array().cast("array<string>")
        has = lambda mark: F.exists(tokens, lambda t: F.contains(t, F.lit(mark)))
        first = F.when(has(MARK), template(tokens)).otherwise(tokens)
        other = F.when(has(MARK + "q"), template(line_starts_as_words(tokens))).otherwise(empty)
        raw = F.when(has(MARK), words(tokens)).otherwise(empty)
        literal = lambda a, c: F.when(F.size(c) > 0, c).otherwise(a)
        return bind(first, lambda a: bind(other, lambda b: bind(raw, lambda c: F.concat(
            *[each(a, b, c, size) for size in sizes],
            *[entries(rolled(literal(a, c), size)) for size in literal_sizes],
        ))))

    return bind(marked_words(text), every)


def _short_items(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """Whole sentences or lines of ``docs`` that are items of under ``LEAST_WORDS`` words.

    See ``_rare_phrases`` for such items inside a sentence.
    """
    short = items.filter(F.size("raw").between(1, LEAST_WORDS - 1)).select(
        "item_id", F.size("sentences").alias("size"), "sentences"
    )
    sizes = [r[0] for r in short.select("size").distinct().collect()]
    texts = docs.select(
        F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
        sentences(F.col("text")).alias("tokens"),
    )
    found = []
    for size in sizes:
        known = short.filter(F.col("size") == size).select(
            "item_id", rolled(F.col("sentences"), size)[0].alias("hash")
        )
        hits = texts.select(
            "doc_id", "text_hash",
            F.posexplode(bind(F.col("tokens"), lambda t: F.transform(
                rolled(t, size), lambda h, i: F.when(F.get(t, i) == END, h)
            ))).alias("pos", "hash"),
        ).filter("hash is not null").join(known, "hash")
        found.append(hits.groupBy("doc_id", "text_hash", "item_id").agg(F.min("pos").alias("pos")))
    if not found:
        return None
    first = reduce(DataFrame.unionByName, found).alias("f")
    same = F.col("f.doc_id").eqNullSafe(F.col("t.doc_id")) & (
        F.col("f.text_hash") == F.col("t.text_hash")
    )
    before = F.filter(F.slice(F.col("t.tokens"), 1, F.col("pos")), lambda w: w != END)
    return first.join(texts.dropDuplicates(["doc_id", "text_hash"]).alias("t"), same).select(
        "f.doc_id", "f.text_hash", "item_id", F.size(before).alias("start")
    )


def _rare_phrases(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """``hits`` of short items inside sentences, of those items that few different texts hold."""
    texts = docs.select(F.xxhash64("text")).distinct().count()
    held = hits.groupBy("item_id").agg(F.countDistinct("text_hash").alias("held"))
    rare = held.filter(F.col("held") <= max(RARE_TEXTS, RARE_SHARE * texts)).select("item_id")
    found = hits.join(F.broadcast(rare), "item_id", "left_semi")
    return found.groupBy("doc_id", "text_hash", "item_id").agg(F.min("start").alias("start"))


def _broadcast(windows: DataFrame) -> DataFrame:
    """``windows``, to be broadcast if their bytes, which are summed first, are few."""
    width = F.octet_length(F.to_json(F.struct("*"))) + 64
    held = windows.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(windows) if held <= BROADCAST_BYTES else windows


def _runs(doc: Column) -> Column:
    """Runs of the windows at ``at``, which cover all words between: counts and slots.

    ``doc`` has the document's words; word ``i`` of the item stands at ``start + i``.
    """
    at, size = F.col("at"), F.least(F.size("tokens"), F.lit(WINDOW))
    apart = lambda a, b: F.coalesce(b - a > size, F.lit(True))
    firsts = F.filter(at, lambda p, i: (i == 0) | apart(F.get(at, i - 1), p))
    lasts = F.filter(at, lambda p, i: apart(p, F.get(at, i + 1)))

    def slots(first: Column, last: Column) -> Column:
        pairs = F.transform(F.sequence(first, last + size - 1), lambda i: F.struct(
            F.get("tokens", i).alias("mark"), F.get("raw", i).alias("item"),
            F.get(doc, F.col("start") + i).alias("doc"),
        ))
        return F.filter(pairs, lambda p: F.contains(p.mark, F.lit(MARK)))

    return F.zip_with(firsts, lasts, lambda first, last: F.struct(
        F.size(F.filter(at, lambda p: p.between(first, last))).alias("n"),
        F.size(F.filter("rich_at", lambda p: p.between(first, last))).alias("n_rich"),
        slots(first, last).alias("slots"),
    ))


def _consistent(slots: Column) -> Column:
    """At least half of the places of repeated names agree with another place of the name.

    The value must be that of half of the name's places or more.
    """

    def judge(names: Column) -> Column:
        places = lambda t: F.size(F.filter(names, lambda u: u.item == t.item))
        equal = lambda t: F.size(F.filter(
            names, lambda u: (u.item == t.item) & (u.doc == t.doc)
        ))
        repeated = F.filter(names, lambda t: places(t) > 1)
        agree = F.filter(repeated, lambda t: (equal(t) > 1) & (equal(t) * 2 >= places(t)))
        return F.size(agree) * 2 >= F.size(repeated)

    return bind(F.filter(slots, lambda p: F.contains(p.mark, F.lit(MARK + "p"))), judge)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Items of ``benchmark(item_id, text)`` found in ``docs(doc_id, text)``.

    One row per document and item: ``doc_id``, ``text_hash`` (rows that share both are
    one document), ``item_id``, ``start`` (word of the document), ``n_windows`` and
    ``cover`` (share of the item's windows), ``exact`` (no slot in them differs). Items of fewer
    than ``WINDOW`` words are looked for as a whole, those under ``LEAST_WORDS`` word for
    word: as whole sentences or lines, and those of ``PHRASE_WORDS`` or more also inside
    sentences, unless more than ``RARE_TEXTS`` texts and ``RARE_SHARE`` of all hold them.
    Items of equal id count as one text each. Null and empty texts match nothing, and an
    empty table on either side gives no rows. Long texts are read whole, copies of a row
    give one result, and columns besides those named may have any names.
    """
    items = benchmark.select(
        F.col("item_id").alias("item_id"), F.xxhash64("text").alias("item_hash"),
        marked_words(F.col("text")).alias("marked"), sentences(F.col("text")).alias("sentences"),
    ).dropDuplicates(["item_id", "item_hash"]).select(
        F.struct("item_id", "item_hash").alias("item_id"), template(F.col("marked")).alias("tokens"),
        template(line_starts_as_words(F.col("marked"))).alias("tokens_b"), words(F.col("marked")).alias("raw"), "sentences",
    )
    whole = _short_items(docs, items)
    phrases = items.filter(F.size("raw").between(PHRASE_WORDS, LEAST_WORDS - 1)).select(
        "item_id", F.size("raw").alias("size"), "raw"
    )
    short_sizes = [r[0] for r in phrases.select("size").distinct().collect()]
    items = items.filter(F.size("tokens") >= LEAST_WORDS).drop("sentences")
    sizes = [
        r[0] for r in items.select(F.least(F.size("tokens"), F.lit(WINDOW))).distinct().collect()
    ]
    known = reduce(DataFrame.unionByName, [_window_table(items, n) for n in sizes or [WINDOW]])
    seen = [
        phrases.filter(F.col("size") == n).select(
            "item_id", "size", rolled(F.col("raw"), n)[0].alias("hash"), F.lit(0).alias("item_pos"),
            F.lit(False).alias("rich"), F.lit(True).alias("literal"),
        )
        for n in short_sizes
    ]
    wanted = reduce(DataFrame.unionByName, [known, *seen])
    rows = docs.select(
        F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
        F.inline(_document_windows(F.col("text"), sizes or [WINDOW], short_sizes)),
    )
    # A window's hash tells its length as well; one long key is the cheapest to look up.
    hits = rows.join(_broadcast(wanted), "hash").select(
        "doc_id", "text_hash", "item_id", "item_pos", "rich", "literal", "size",
        (F.col("pos") - F.col("item_pos")).alias("start"),
    )
    # Hits are few beside the windows, and short items' rarity needs them a second time.
    if short_sizes:
        hits = staged(hits, "benchmark-hits")
    found = hits.filter(F.col("size") >= LEAST_WORDS).drop("size")
    short = whole
    if short_sizes:
        inside = _rare_phrases(hits.filter(F.col("size") < LEAST_WORDS), docs)
        short = inside if short is None else short.unionByName(inside)
    totals = known.groupBy("item_id").agg(
        F.countDistinct("item_pos").alias("windows"),
        F.countDistinct(F.when(F.col("rich"), F.col("item_pos"))).alias("rich_windows"),
    )
    # Copies of a row repeat its hits: places are counted, not rows.
    diagonals = found.groupBy("doc_id", "text_hash", "item_id", "start").agg(
        F.sort_array(F.collect_set("item_pos")).alias("at"),
        F.collect_set(F.when(F.col("rich"), F.col("item_pos"))).alias("rich_at"),
        F.size(F.collect_set(F.when(F.col("literal"), F.col("item_pos")))).alias("n_literal"),
    )

    def enough(found: Column, of: str) -> Column:
        needed = F.least(F.lit(ENOUGH_WINDOWS), F.ceil(F.col(of) * MIN_COVER))
        return (found > 0) & (found >= needed)

    # A changed copy need not repeat the windows that only match word for word.
    likely = enough(F.size("rich_at"), "rich_windows") | enough(F.size("at"), "windows")
    candidates = (
        diagonals.join(totals, "item_id").filter(likely).join(items, "item_id")
    ).alias("c")
    texts = docs.select(
        F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
        F.col("text").alias("text"),
    ).alias("t")
    same = F.col("c.doc_id").eqNullSafe(F.col("t.doc_id")) & (
        F.col("c.text_hash") == F.col("t.text_hash")
    )
    checked = candidates.join(texts, same).select(
        "c.doc_id", "c.text_hash", F.col("item_id.item_id").alias("item_id"), "start",
        F.size("at").cast("long").alias("n_windows"), "n_literal", "windows", "rich_windows",
        (F.size("at") / F.col("windows")).alias("cover"),
        bind(words(marked_words(F.col("text"))), _runs).alias("runs"),
    )
    agreeing = F.filter("runs", lambda r: _consistent(r.slots))
    total = lambda name: F.aggregate(
        agreeing, F.lit(0), lambda n, r: n + r[name]
    )
    accepted = (
        enough(F.col("n_literal"), "windows")
        | enough(total("n_rich"), "rich_windows") | enough(total("n"), "windows")
    )
    differs = F.exists("runs", lambda r: F.exists(r.slots, lambda p: p.item != p.doc))
    best = F.max_by(
        F.struct("start", "n_windows", "cover", "exact"),
        F.struct("n_windows", -F.col("start")),
    )
    matches = checked.filter(accepted).select(
        "doc_id", "text_hash", "item_id", "start", "n_windows", "cover", (~differs).alias("exact")
    )
    if short is not None:
        matches = matches.unionByName(short.select(
            "doc_id", "text_hash", F.col("item_id.item_id").alias("item_id"), "start",
            F.lit(1).cast("long").alias("n_windows"), F.lit(1.0).alias("cover"),
            F.lit(True).alias("exact"),
        ))
    return (
        matches.groupBy("doc_id", "text_hash", "item_id").agg(best.alias("best"))
        .select("doc_id", "text_hash", "item_id", "best.*")
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item; all columns stay as they are."""
    marked = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
        docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("text_hash"),
    ).alias("d")
    found = contamination(docs, benchmark).select("doc_id", "text_hash").distinct().alias("f")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (
        F.col("d.text_hash") == F.col("f.text_hash")
    )
    return marked.join(found, same, "left_anti").select("row.*")
