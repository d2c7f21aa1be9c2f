"""Line deduplication by an exact set-similarity join, in DataFrame operations only.

A line is the set of its lower-cased words. Words are ordered by rarity, read from a sketch of fixed size that counts the
whole corpus; any common order is right, a better one only makes fewer candidates. Two lines with a Jaccard similarity
of at least 4/5 share a word in their prefixes, and share two in prefixes one word longer: a rare word is a key by
itself, a frequent one only together with a second, so that no key gathers much by chance. Candidates pass the length
filter, the positional filter and a parity filter (128 bits that each word flips one of: the differing bits never exceed
the differing words), then the sets are compared. Lines of equal text are one class, joined once, at its earliest place.

A word whose count bounds its group to a small one needs no count of the group: its lines are joined as they are. Of the
others, in a small group every line meets every earlier one. In a larger group it first meets the earliest, so that a large
family of near copies makes as many candidates as it has members; a line that can't be similar to that one, or turns out
not to be, meets the others too. In very large groups it does so in turns, the next few earlier members first and eight
times as many each turn, and leaves as soon as one is similar; before that it tries the first few of its largest group. Two words that are both so frequent that very many lines
must have them by chance are a key only together with a third. Of two lines the shorter has the rarest common word in a prefix of one ninth of its words: only such rows look for others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import written

#: Jaccard 4/5 as whole numbers; bits of a membership sketch; buckets of the rarity sketch; members up to which all of a
#: group meet; members up to which a group is joined with itself at once, and its frequency code: up to that a word is a
#: key by itself (one row that is compared with up to so many others costs less than the rows of its pairs of words);
#: pairs of one earlier class that are compared in one lane; earlier members that the first turn through a large group
#: takes, and how many times as many each turn after it.
NUM, DEN = 4, 5
MEMBER_BITS = 1 << 25
BUCKETS, BLOCK = 1 << 20, 1 << 10
SMALL, LARGE = 128, 1024
RARE_CODE = 42
LANE = 64
TURN, GROWTH = 16, 8
_WORD = "[^ \\t\\n\\x0B\\f\\r]"


def byte_sketch(codes: DataFrame) -> Column:
    """A scalar of BUCKETS bytes from rows (bucket, code); 1 where no row is. Its size doesn't follow the data."""
    spark = codes.sparkSession
    filled = (
        codes.select(F.col("bucket").cast("long"), F.col("code").cast("int"))
        .unionByName(spark.range(BUCKETS).select(F.col("id").alias("bucket"), F.lit(1).alias("code")))
        .groupBy("bucket")
        .agg(F.max("code").alias("code"))
    )
    one = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", F.char("code").alias("c")))), lambda x: x.c), "")
    blocks = filled.groupBy((F.col("bucket") / BLOCK).cast("int").alias("block")).agg(one.alias("part"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda x: x.part), "")
    return written(blocks.agg(whole.cast("binary").alias("sketch")), "sketch").scalar()


def looked_up(sketch: Column, value: Column) -> Column:
    at = (F.pmod(value, F.lit(BUCKETS)) + 1).cast("int")
    return F.ascii(F.substring(sketch, at, F.lit(1)).cast("string"))


def member_bits(values: DataFrame) -> Column:
    """A scalar of MEMBER_BITS bits from one column of longs, by their values' remainders: false members, none missed."""
    spark = values.sparkSession
    at = F.pmod(F.col(values.columns[0]), F.lit(MEMBER_BITS)) + 1
    parts = (
        values.groupBy(F.bitmap_bucket_number(at).alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
        .unionByName(spark.range(1, MEMBER_BITS // 32768 + 1).select(F.col("id").alias("part"), F.lit(b"").cast("binary").alias("bits")))
        .groupBy("part")
        .agg(F.rpad(F.max(F.hex("bits")), 8192, "0").alias("bits"))
    )
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "bits"))), lambda x: x.bits), "")
    return written(parts.agg(F.unhex(whole).alias("bits")), "members").scalar()


def may_be_in(bits: Column, value: Column) -> Column:
    at = F.pmod(value, F.lit(MEMBER_BITS))
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return F.call_function("shiftright", byte, at.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1


def words(text: Column) -> Column:
    """The words of a text in lower case, with empty strings among them; cheaper than a split by a pattern."""
    text = F.lower(text)
    for space in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.split(text, " ", -1)


def rarity(docs: DataFrame) -> Column:
    """How often words occur, four steps to a doubling: code 2 is once; the count is of all words in the bucket."""
    counted = (
        docs.select(F.explode(words(F.col("text"))).alias("word"))
        .where("word <> ''")
        .groupBy(F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).alias("bucket"))
        .agg(F.count("*").alias("n"))
    )
    code = F.least(F.lit(127), F.floor(F.log2(F.col("n")) * 4) + 2)
    return byte_sketch(counted.select("bucket", code.alias("code")))


def row_key(docs: DataFrame) -> Column:
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, line_no, line, cls (the text's name) for every line with words."""
    rows = docs.select("doc_id", row_key(docs).alias("row_key"), "text")
    return (
        rows.select("doc_id", "row_key", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
        .where(F.col("line").rlike(_WORD))
        .withColumn("cls", F.xxhash64("line"))
    )


def once_each(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """cls, line, doc_id, line_no of every class, at its earliest place. Only lines that may be repeated move."""
    listed = member_bits(repeated.select("cls"))
    several = (
        lines.where(may_be_in(listed, F.col("cls")))
        .groupBy("cls")
        .agg(F.first("line").alias("line"), F.min(F.struct("doc_id", "line_no")).alias("place"))
        .select("cls", "line", "place.doc_id", "place.line_no")
    )
    return lines.where(~may_be_in(listed, F.col("cls"))).select("cls", "line", "doc_id", "line_no").unionByName(several)


def named_words(line: Column) -> Column:
    return F.transform(F.array_remove(words(line), ""), lambda w: F.xxhash64(w))


def ranked(lines: DataFrame, sketch: Column) -> DataFrame:
    """cls, doc_id, line_no, ranked: the names of the line's words, rarest first (the rarity code above 56 bits of hash).

    Spark takes no subquery inside a higher-order function, so an outer one takes the sketch from a column. The optimizer
    puts the subquery in the column's place: no row carries the sketch.
    """
    def coded(held: Column, x: Column) -> Column:
        return F.shiftleft(looked_up(held, x).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(x, 8))

    names = F.transform(F.array("held"), lambda held: F.transform(named_words(F.col("line")), lambda x: coded(held, x)))
    return lines.select("cls", "doc_id", "line_no", "line", sketch.alias("held")).select(
        "cls", "doc_id", "line_no", F.sort_array(F.array_distinct(F.element_at(names, 1))).alias("ranked")
    )


#: The columns of a set's parity: 128 bits that each word flips one of.
PARITY = ("p0", "p1")


def parity(k: int) -> Column:
    """The k-th 64 bits of the parity of ``ranked``; never null."""
    names = F.filter("ranked", lambda x: x.bitwiseAND(F.lit(64)) == 64 * k)
    flip = lambda s, x: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int")))
    none = F.lit(0).cast("long")
    return F.coalesce(F.aggregate(names, none, flip), none).alias(PARITY[k])


def prefixes(lines: DataFrame, sketch: Column) -> DataFrame:
    """cls, doc_id, line_no, n, p (the length of the prefix), p0 and p1 (parity), ranked (the prefix and two words more), written."""
    length = F.expr(f"n - (n * {NUM} + {DEN - 1}) div {DEN} + 1").cast("int")
    rows = ranked(lines, sketch).select("*", F.size("ranked").alias("n"), *map(parity, range(len(PARITY)))).withColumn("p", length)
    return written(rows.withColumn("ranked", F.slice("ranked", F.lit(1), F.col("p") + 2)), "prefixes")


def small_code() -> int:
    """The rarity code up to which a word is in at most SMALL lines, as its bucket is."""
    return min(RARE_CODE, int(4 * math.log2(SMALL)) + 1)


def _never_null(rows: DataFrame) -> DataFrame:
    """Never null, else the join asks one side for that, and the sides no longer share their exchange."""
    return rows.select(*(F.coalesce(c, F.lit(0).cast(t)).alias(c) if c in ("key", "cls", "n", "i", *PARITY) else c for c, t in rows.dtypes))


def small_keys(rows: DataFrame) -> DataFrame:
    """The rows of ``signatures`` whose key is one word that few lines have, from the rows of ``prefixes``."""
    own = rows.where("n >= 4").select("cls", "doc_id", "line_no", "n", *PARITY, F.posexplode(F.slice("ranked", F.lit(1), F.col("p"))).alias("pos", "key"))
    code = F.shiftright("key", 56)
    own = own.where((code > 2) & (code <= small_code()))
    return _never_null(own.select("key", "cls", "n", (F.col("pos") + 1).alias("i"), *PARITY, "doc_id", "line_no"))


def signatures(rows: DataFrame, n_lines: int) -> DataFrame:
    """key, cls, n, i (the place of the key's first word in the line's order), p0 and p1 (parity), doc_id and line_no.

    For the rows of ``prefixes``, without the keys that ``small_keys`` has.
    """
    zero = F.lit(0)
    # Sets of fewer than 4 words have no partner but their equals: the whole set is their key.
    whole = F.col("n") < 4
    firsts = F.when(whole, F.array(F.xxhash64("ranked"))).otherwise(F.slice("ranked", F.lit(1), F.col("p")))
    rows = rows.select("*", F.posexplode(firsts).alias("pos", "own"))
    code = F.shiftright("own", 56)
    rows = rows.where(whole | ((code > 2) & (code > small_code())))
    # Codes are four times the logarithm, plus 2: the lines that have two words by chance.
    often = (RARE_CODE - 2) + 4 * math.log2(max(n_lines, 1))

    def pair_keys(second: Column, at: Column) -> Column:
        thirds = F.slice("ranked", F.col("pos") + at + 3, F.greatest(F.col("p") - F.col("pos") - at, zero))
        crowded = code + F.shiftright(second, 56) - 4 > often
        return F.when(crowded, F.transform(thirds, lambda third: F.xxhash64("own", second, third))).otherwise(
            F.array(F.xxhash64("own", second))
        )

    seconds = F.slice("ranked", F.col("pos") + 2, F.col("p") - F.col("pos"))
    keys = F.when(whole | (code <= RARE_CODE), F.array("own")).otherwise(F.flatten(F.transform(seconds, pair_keys)))
    rows = rows.select("cls", "doc_id", "line_no", "n", *PARITY, "pos", F.explode(keys).alias("key"))
    return _never_null(rows.select("key", "cls", "n", (F.col("pos") + 1).alias("i"), *PARITY, "doc_id", "line_no"))


def can_match(a: str, b: str) -> Column:
    """Length, positional and parity filters: true for every pair that reaches the similarity."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    i, j = F.col(f"{a}.i"), F.col(f"{b}.i")
    need = F.ceil((n + m) * NUM / (NUM + DEN))  # the least overlap
    most = F.least(i, j) + F.least(n - i, m - j)  # what can be shared up to the key's word, and after it
    bits = sum((F.bit_count(F.col(f"{a}.{name}").bitwiseXOR(F.col(f"{b}.{name}"))) for name in PARITY), F.lit(0))
    return (DEN * n >= NUM * m) & (DEN * m >= NUM * n) & (most >= need) & (bits <= n + m - 2 * need)


def _earlier(a: str, b: str) -> Column:
    return F.struct(f"{a}.doc_id", f"{a}.line_no", f"{a}.cls") < F.struct(f"{b}.doc_id", f"{b}.line_no", f"{b}.cls")


def small_groups(rows: DataFrame) -> DataFrame:
    """a (earlier class), b, members (a bound): the candidates at the keys of ``small_keys``."""
    dealt = rows.repartition("key")
    shorter = F.struct("l.n", "l.cls") < F.struct("r.n", "r.cls")
    # Of both sides' sizes, so that the sides stay alike and share their exchange.
    n = F.least("l.n", "r.n")
    at_index = F.col("l.i") <= n - F.ceil(n * 2 * NUM / (NUM + DEN)) + 1
    both = dealt.alias("l").join(dealt.alias("r"), (F.col("l.key") == F.col("r.key")) & shorter & at_index & can_match("l", "r"))
    first = _earlier("l", "r")
    a, b = F.when(first, F.col("l.cls")).otherwise(F.col("r.cls")), F.when(first, F.col("r.cls")).otherwise(F.col("l.cls"))
    return written(both.select(a.alias("a"), b.alias("b"), F.lit(SMALL).cast("long").alias("members")), "small-groups")


def keyed_groups(sigs: DataFrame) -> DataFrame:
    """Two kinds of rows in one table, so that one job makes them from one exchange by key.

    Candidates: a (earlier class), b, members (of their group); key is null. Of groups that are gone through again (those
    over LARGE, and those over SMALL with lines that only met the earliest): key, own, nth (its place), members, first
    (the earliest class) and near (whether the two can be similar), for all other classes of the group.
    """
    group = Window.partitionBy("key").orderBy("doc_id", "line_no", "cls")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = sigs.repartition("key").select(
        "*",
        F.row_number().over(group).alias("nth"),
        F.count("*").over(whole).alias("members"),
        F.first(F.struct("n", "i", *PARITY)).over(whole).alias("centre"),
    )
    row = F.struct("cls", "n", "i", *PARITY, "doc_id", "line_no")
    counted = counted.select("key", row.alias("own"), "centre", "nth", "members").where("members > 1")
    near = (F.col("members") > SMALL) & (F.col("nth") > 1) & can_match("centre", "own")
    counted = counted.select("key", "own", "nth", "members", near.alias("near"))
    again = F.max(F.col("near")).over(Window.partitionBy("key")) | (F.col("members") > LARGE)
    counted = counted.withColumn("again", again)
    left = counted.where(F.col("again") | (F.col("own.i") <= _index("own"))).alias("l")
    right = counted.where((F.col("members") <= LARGE) | (F.col("nth") == 1)).select("key", "own", "nth", "near").alias("r")
    l_first, big = F.col("l.nth") < F.col("r.nth"), F.col("l.members") > SMALL
    to_centre = F.col("l.again") & (F.col("r.nth") == 1) & (F.col("l.nth") > 1)
    shorter = F.struct("l.own.n", "l.own.cls") < F.struct("r.own.n", "r.own.cls")
    in_turn = ~big | F.when(l_first, (F.col("l.nth") == 1) | ~F.col("r.near")).otherwise((F.col("r.nth") == 1) | ~F.col("l.near"))
    centred = F.col("l.again") & (F.least("l.nth", "r.nth") == 1)
    meet = (F.col("l.members") <= LARGE) & (F.col("l.own.i") <= _index("l.own")) & shorter & in_turn & ~centred
    both = left.join(right, (F.col("l.key") == F.col("r.key")) & (to_centre | (meet & can_match("l.own", "r.own"))))
    a, b = F.col("l.own.cls"), F.col("r.own.cls")
    return written(
        both.select(
            F.when(~to_centre, F.when(l_first, a).otherwise(b)).alias("a"),
            F.when(~to_centre, F.when(l_first, b).otherwise(a)).alias("b"),
            F.when(to_centre, F.col("l.key")).alias("key"),
            F.when(to_centre, F.col("l.own")).alias("own"),
            F.when(to_centre, b).alias("first"),
            F.col("l.near").alias("near"),
            F.col("l.nth").alias("nth"),
            F.col("l.members").alias("members"),
        ),
        "met-or-seen",
    )


def _index(row: str) -> Column:
    """The prefix in which a line has the rarest word in common with a similar line that isn't shorter."""
    n = F.col(f"{row}.n")
    return n - F.ceil(n * 2 * NUM / (NUM + DEN)) + 1


def meetings(late: DataFrame, early: DataFrame) -> DataFrame:
    """a (earlier class), b, members: the rows (key, late, members) with the earlier of the rows (key, early).

    Only at keys that are in the shorter one's index prefix: the rarest word in common always is.
    """
    at_index = F.when(F.col("early.n") <= F.col("late.n"), F.col("early.i") <= _index("early")).otherwise(F.col("late.i") <= _index("late"))
    return (
        late.join(early, "key")
        .where(_earlier("early", "late") & at_index & can_match("early", "late"))
        .select(F.col("early.cls").alias("a"), F.col("late.cls").alias("b"), "members")
    )


def candidates(met: DataFrame, seen: DataFrame) -> DataFrame:
    """a (earlier class), b, members, skipped: b's other earlier candidates of the group were left out."""
    first = seen.where("near").select(F.col("first").alias("a"), F.col("own.cls").alias("b"), "members", F.lit(True).alias("skipped"))
    full = met.select("a", "b", "members").withColumn("skipped", F.lit(False))
    return full.unionByName(first).groupBy("a", "b").agg(F.max("members").alias("members"), F.max("skipped").alias("skipped"))


def joined(pairs: DataFrame, a_side: DataFrame, b_side: DataFrame) -> DataFrame:
    """The pairs with the columns of both classes: ``a_side`` by a, ``b_side`` by b.

    One earlier class may be in very many pairs. Its row goes to as many lanes as its pairs are dealt to.
    """
    lanes = pairs.select("a", "lane").distinct().join(a_side, "a")
    return pairs.join(lanes, ["a", "lane"]).join(b_side, "b")


def verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs and whether they are similar. Only lines of these classes move, by a sketch of the classes."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    texts = (
        lines.where(may_be_in(member_bits(named), F.col("cls")))
        .groupBy("cls")
        .agg(F.first("line").alias("line"))
        .join(named, "cls", "left_semi")
    )
    sets = written(texts.select("cls", F.array_distinct(named_words(F.col("line"))).alias("names")), "line-sets")
    lane = F.pmod(F.xxhash64("b"), F.ceil(F.col("members") / LANE))
    dealt = pairs.select("a", "b", "skipped", lane.alias("lane"))
    both = joined(
        dealt,
        sets.select(F.col("cls").alias("a"), F.col("names").alias("left")),
        sets.select(F.col("cls").alias("b"), F.col("names").alias("right")),
    )
    overlap = F.size(F.array_intersect("left", "right"))
    union = F.size("left") + F.size("right") - overlap
    return both.select("a", "b", "skipped", (overlap * DEN >= union * NUM).alias("similar"))


def matched_classes(lines: DataFrame, repeated: DataFrame, sketch: Column, n_lines: int) -> DataFrame:
    """cls of every class that some earlier class is similar to."""
    rows = prefixes(once_each(lines, repeated), sketch)
    few = small_groups(small_keys(rows))
    both = keyed_groups(signatures(rows, n_lines))
    seen = both.where("key IS NOT NULL").select("key", "own", "nth", "first", "near", "members")
    met = both.where("key IS NULL").select("a", "b", "members").unionByName(few)
    met = written(candidates(met, seen), "line-pairs")
    judged = written(verified(met, lines), "judged-pairs")
    matched = judged.where("similar").select(F.col("b").alias("cls")).distinct()
    # Who met nobody but the earliest, and those of very large groups whom that one can't be similar to.
    waiting = seen.where(F.col("near") | (F.col("members") > LARGE)).withColumn("cls", F.col("own.cls"))
    low, width, last = 2, TURN, seen.agg(F.max("nth")).first()[0] or 0
    largest = True
    while low <= last:
        waiting = written(waiting.where(F.col("nth") > low).join(matched, "cls", "left_anti"), "unsettled")
        if waiting.isEmpty():
            break
        late = waiting.select("cls", "key", F.col("own").alias("late"), "members", "nth")
        if largest:  # a family's lines share many keys: one is enough to try a few of it
            late = late.groupBy("cls").agg(F.max_by(F.struct("key", "late", "members"), F.struct(F.col("late.i") <= _index("late"), "members", "key")).alias("row")).select("row.*")
        turn = seen.where(F.col("nth").between(low, low + width - 1)).select("key", F.col("own").alias("early"))
        more = meetings(late, turn).groupBy("a", "b").agg(F.max("members").alias("members")).withColumn("skipped", F.lit(False))
        more = written(more, "more-pairs")
        if not more.isEmpty():
            found = verified(more, lines).where("similar").select(F.col("b").alias("cls"))
            matched = written(matched.unionByName(found).distinct(), "matched-lines")
        if not largest:
            low, width = low + width, width * GROWTH
        largest = False
    return matched


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, gone: the numbers of the lines that go, for each document that loses any."""
    lines = line_rows(docs)
    places = written(lines.select("cls", "doc_id", "row_key", "line_no"), "line-places")
    repeated = (
        places.groupBy("cls")
        .agg(F.min(F.struct("doc_id", "line_no")).alias("place"), F.count("*").alias("members"))
        .where("members > 1")
    )
    repeated = written(repeated.select("cls", "place"), "repeated-lines")
    matched = matched_classes(lines, repeated, rarity(docs), places.count()).withColumn("matched", F.lit(True))
    late = written(repeated.join(matched, "cls", "full"), "late-classes")
    gone = places.join(late, "cls").where("matched OR struct(doc_id, line_no) > place")
    return written(gone.groupBy("doc_id", "row_key").agg(F.collect_set("line_no").alias("gone")), "lines-gone")


def edited(docs: DataFrame) -> DataFrame:
    """doc (the row as a struct, its text edited), n_lines and n_removed. Only documents that lose lines move."""
    gone = removed_lines(docs)
    listed = member_bits(gone.select("row_key"))
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), row_key(docs).alias("row_key"))
    touched = may_be_in(listed, F.col("row_key"))
    lines = F.split("doc.text", "\n", -1)
    kept = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains("gone", i)), "\n")
    n_lines = F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines")
    same = keyed.where(~touched).select("doc", n_lines, F.lit(0).cast("long").alias("n_removed"))
    same_row = (keyed["row_key"] == gone["row_key"]) & keyed["doc.doc_id"].eqNullSafe(gone["doc_id"])
    moved = keyed.where(touched).join(gone, same_row, "left")
    return same.unionByName(
        moved.select(
            F.col("doc").withField("text", F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(kept)).alias("doc"),
            n_lines,
            F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        )
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents, all columns as they were, with ``text`` less its repeated lines.

    A line goes if an earlier one, by doc_id (null first) and line number, has a word set of Jaccard similarity 4/5 or
    more to it, whether or not that one goes too. Words are lower-cased and parted by ASCII white space; lines end at
    line feeds. Lines without words stay. Lines at one doc_id and number are not earlier than each other, so rows that
    repeat doc_id and text come back alike. Null text stays null. A document all of whose lines go has an empty text.
    Empty table: no rows. Extra columns are carried along.
    """
    return edited(docs).select("doc.*")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept_sha256 (of the text left; null counts as empty).

    The rules and cases are those of ``deduplicate``. Columns other than doc_id and text are not read.
    """
    text = F.coalesce("doc.text", F.lit("")).cast("binary")
    return edited(docs.select("doc_id", "text")).select(
        "doc.doc_id", "n_lines", "n_removed", F.sha2(text, 256).alias("kept_sha256")
    )
