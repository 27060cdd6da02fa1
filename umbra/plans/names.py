"""Labelled texts derived from the tables `customer` and `nation`: invented persons and places in sentences, for the tagger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.sources.tables import spread

FIRST = ("Al", "Be", "Cor", "Da", "El", "Fa", "Gre", "Ho", "Iv", "Jo", "Ka", "Lu", "Mi", "Na", "Os", "Pe", "Ro", "Sa", "Ti", "Vi")
FIRST_ENDS = ("an", "rta", "in", "lia", "mund", "na", "or", "rik", "ssa", "ven", "wyn")
LAST = ("Ander", "Bran", "Carl", "Dort", "Ell", "Fisch", "Grun", "Hart", "Ing", "Kess", "Lind", "Mor", "Nord", "Oster", "Pell", "Quin", "Rosen")
LAST_ENDS = ("sen", "mann", "er", "ovic", "ski", "ini", "eau", "feld", "quist", "aker", "ley", "strom", "inho")
CITY = ("Ash", "Brook", "Clay", "Dun", "East", "Fair", "Glen", "High", "Kirk", "Long", "Mill", "North", "Oak", "Stone", "West")
CITY_ENDS = ("burg", "ville", "ton", "ford", "haven", "stadt", "mouth", "field", "grad")
THINGS = ("Invoice", "Monday", "Parcel", "Contract", "Engine", "Harvest", "Ledger", "Winter", "Delivery")
#: {p} a person, {l} a place, {t} a capitalised word that is neither.
SENTENCES = (
    "Yesterday {p} moved to {l} with the whole family.", "The {t} was signed by {p} near {l}.", "Dear {p}, the {t} from {l} has arrived.", "{p} lives in {l} and works for the harbour.",
    "Our office at {l} expects {p} on Tuesday.", "Nobody in {l} knew why {p} sold the house.", "{t} and Finance met again, but nothing was settled.", "The {t} Report of March was read without remarks.",
    "According to {p}, the {t} is late.", "Trains from {l} to the coast are slow.", "We asked {p} about {l} twice.", "{p} wrote: the road through {l} is closed.", "A Letter came, and the {t} Board answered it.",
)


def _pick(of: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, of)), F.pmod(n, F.lit(len(of))).cast("int") + 1)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text and spans: two sentences a customer; every seventh place is the customer's nation."""
    customers = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey"), "c_custkey")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.initcap("n_name").alias("nation"))
    rows = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    h = lambda salt: F.pmod(F.xxhash64(F.lit(salt), "c_custkey", "n"), F.lit(1 << 30))
    rows = rows.select("c_custkey", "nation", F.explode(F.array(F.lit(0), F.lit(1))).alias("n"))
    rows = rows.withColumns({
        "p": F.concat(_pick(FIRST, h(1)), _pick(FIRST_ENDS, h(2)), F.lit(" "), _pick(LAST, h(3)), _pick(LAST_ENDS, h(4))),
        "l": F.when(F.col("c_custkey") % 7 == 0, F.col("nation")).otherwise(F.concat(_pick(CITY, h(5)), _pick(CITY_ENDS, h(6)))),
        "form": _pick(SENTENCES, F.col("c_custkey") * 2 + F.col("n")),
    })
    text = F.replace(F.replace(F.replace("form", F.lit("{p}"), F.col("p")), F.lit("{l}"), F.col("l")), F.lit("{t}"), _pick(THINGS, h(7)))
    rows = rows.withColumn("text", text)
    span = lambda mark, c, kind: F.when(F.contains("form", F.lit(mark)), F.struct((F.instr("text", F.col(c)) - 1).alias("start"), (F.instr("text", F.col(c)) - 1 + F.char_length(c)).alias("end"), F.lit(kind).alias("entity_type")))
    spans = F.array_sort(F.array_compact(F.array(span("{p}", "p", "PERSON"), span("{l}", "l", "LOCATION"))))
    return rows.select((F.col("c_custkey") * 2 + F.col("n")).alias("id"), "c_custkey", "text", spans.alias("spans"))
