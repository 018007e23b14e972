"""Lines repeated across one site's documents: compressed bitmaps of each line's documents, per source.

A line's documents are kept as bitmaps of 32,768 ids each, by bucket of the document's number. Lines that stand in fewer
than ``least`` documents can't qualify whatever their site's size, so they get no bitmap: their exact number is known from a
count with map-side combining. Variants of a line (other white space at its ends) are united by or-ing their bitmaps; the
cardinality of the union is exact. A line is deleted from a document if the document's bit is set in the line's bitmap.

At least ``share`` of a site's records hold a repeated line, so a site has at most (lines per record) / share of them;
the bitmaps are broadcast only if their counted number is small, else joined by shuffle.

Edge cases: null documents count among the records of their site and have no lines; a null site is a site of its own;
blank lines are never repeated lines; a line twice in a document counts once but is removed at both places; lines may be
very long (they are compared by 128-bit hash); an empty table gives an empty result. Ids must be unique and not negative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.session import cut, small

LEAST, SHARE = 5, 0.03
#: Bitmaps (4 KB each) that may be broadcast.
BITMAPS = 5_000
_NO_SITE = "\x00"


def numbered_lines(df: DataFrame, id: str, site: str, text: str) -> DataFrame:
    """(id, site, line_no, raw, h1, h2): every line; h1, h2 hash it without spaces, tabs and carriage returns at both ends; null for a blank line."""
    rows = df.where(F.col(text).isNotNull()).select(F.col(id).alias("id"), F.coalesce(site, F.lit(_NO_SITE)).alias("site"), F.posexplode(F.split(text, "\n")).alias("line_no", "raw"))
    line = F.regexp_replace("raw", r"^[ \t\r]+|[ \t\r]+$", "")
    rows = rows.withColumn("line", line)
    blank = F.trim(F.regexp_replace("line", r"\s+", "")) == ""
    return rows.select("id", "site", (F.col("line_no") + 1).cast("long").alias("line_no"), "raw", F.when(~blank, F.xxhash64("line")).alias("h1"), F.when(~blank, F.xxhash64(F.reverse("line"), F.lit(5))).alias("h2"))


def line_bitmaps(df: DataFrame, id: str, site: str, text: str, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(site, h1, h2, bucket, bits): the documents of each repeated line as bitmaps."""
    per_document = df.where(F.col(text).isNotNull()).select(F.col(id).alias("id"), F.coalesce(site, F.lit(_NO_SITE)).alias("site"), F.explode(F.array_distinct(F.split(text, "\n"))).alias("raw"))
    line = F.regexp_replace("raw", r"^[ \t\r]+|[ \t\r]+$", "")
    keyed = per_document.withColumn("line", line).where(F.col("line").rlike(r"\S")).select("id", "site", F.xxhash64("line").alias("h1"), F.xxhash64(F.reverse("line"), F.lit(5)).alias("h2"), F.xxhash64("raw").alias("variant"))
    totals = df.groupBy(F.coalesce(site, F.lit(_NO_SITE)).alias("site")).agg(F.count(F.lit(1)).alias("records"))
    # an upper bound of the documents (variants of one document count apart): what fails here can't qualify
    frequent = keyed.groupBy("site", "h1", "h2").agg(F.count(F.lit(1)).alias("most")).where(F.col("most") >= least).join(small(totals), "site").where(F.col("most") >= share * F.col("records")).select("site", "h1", "h2", "records")
    maybe = keyed.join(small(frequent, settle=True), ["site", "h1", "h2"])
    by_variant = maybe.groupBy("site", "h1", "h2", "variant", "records", F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
    united = cut(by_variant.groupBy("site", "h1", "h2", "records", "bucket").agg(F.bitmap_or_agg("bits").alias("bits")))
    size = united.groupBy("site", "h1", "h2", "records").agg(F.sum(F.bitmap_count("bits")).alias("documents"))
    passed = size.where((F.col("documents") >= least) & (F.col("documents") >= share * F.col("records"))).select("site", "h1", "h2")
    return united.join(small(passed), ["site", "h1", "h2"], "left_semi").select("site", "h1", "h2", "bucket", "bits")


def _bit(bits: Column, position: Column) -> Column:
    """Is the bit of a document set in a bitmap?"""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte.cast("long"), F.pmod(position, F.lit(8)).cast("int")) == 1


def flagged(df: DataFrame, id: str, site: str, text: str, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """All lines of ``numbered_lines`` with ``repeated``."""
    lines = numbered_lines(df, id, site, text).withColumns({"bucket": F.bitmap_bucket_number("id"), "position": F.bitmap_bit_position("id")})
    bitmaps = line_bitmaps(df, id, site, text, least, share)
    joined = lines.join(small(bitmaps, BITMAPS), ["site", "h1", "h2", "bucket"], "left")
    return joined.select("id", "line_no", "raw", F.coalesce(_bit(F.col("bits"), F.col("position")), F.lit(False)).alias("repeated"))


def cleaned(df: DataFrame, id: str, site: str, text: str, least: int = LEAST, share: float = SHARE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, cleaned): the documents without the repeated lines of their site. Documents stay in their rows: the bitmaps of a site and bucket come to them."""
    bitmaps = cut(line_bitmaps(df, id, site, text, least, share))
    marks = bitmaps.groupBy(F.col("site").alias("_site"), F.col("bucket").alias("_bucket")).agg(F.collect_list(F.struct("h1", "h2", "bits")).alias("_marks"))
    marks = F.broadcast(marks) if bitmaps.limit(BITMAPS + 1).count() <= BITMAPS else marks
    rows = df.select(F.col(id).alias("id"), *keep, F.coalesce(site, F.lit(_NO_SITE)).alias("_site"), F.col(text).alias("_text"), F.bitmap_bucket_number(id).alias("_bucket"), F.bitmap_bit_position(id).alias("_position")).join(marks, ["_site", "_bucket"], "left")
    strip = lambda x: F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", "")
    lines = F.transform(F.split("_text", "\n"), lambda x: F.struct(x.alias("raw"), F.xxhash64(strip(x)).alias("h1"), F.xxhash64(F.reverse(strip(x)), F.lit(5)).alias("h2")))
    mine = F.transform(F.filter("_marks", lambda m: _bit(m["bits"], F.col("_position"))), lambda m: F.struct(m["h1"].alias("h1"), m["h2"].alias("h2")))
    rows = rows.withColumns({"_lines": lines, "_mine": mine})
    kept = F.filter("_lines", lambda x: ~F.array_contains("_mine", F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"))))
    whole = F.when(F.coalesce(F.size("_mine"), F.lit(0)) > 0, F.array_join(F.transform(kept, lambda x: x["raw"]), "\n")).otherwise(F.col("_text"))
    return rows.select("id", *keep, whole.alias("cleaned"))
