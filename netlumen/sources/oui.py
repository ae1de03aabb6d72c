"""Hardware-vendor registry: a built-in table, extended from registry files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlumen.functions.net import normalize_mac

# Prefix and vendor of equipment common on enterprise networks.
BUILTIN = {
    "00000C": "Cisco",
    "0000AA": "Xerox",
    "000393": "Apple",
    "00049F": "Freescale",
    "0004E2": "SMC",
    "0004F2": "Polycom",
    "000569": "VMware",
    "00095B": "Netgear",
    "00099B": "Juniper",
    "000AF7": "Broadcom",
    "000B86": "Aruba",
    "000BDB": "Dell",
    "000C29": "VMware",
    "000D3A": "Microsoft",
    "000E8F": "Sercomm",
    "000F4B": "Oracle",
    "001018": "Broadcom",
    "001321": "HewlettPackard",
    "001451": "Apple",
    "00155D": "Microsoft",
    "001759": "Fortinet",
    "001788": "Philips",
    "0017A4": "HewlettPackard",
    "00188B": "Dell",
    "001A11": "Google",
    "001AA0": "Dell",
    "001B21": "Intel",
    "001B54": "Cisco",
    "001C14": "VMware",
    "001C23": "Dell",
    "001C7F": "CheckPoint",
    "001D0F": "TPLink",
    "001E8F": "Canon",
    "001F29": "HewlettPackard",
    "0021F6": "Oracle",
    "0023AB": "Cisco",
    "0025B5": "Cisco",
    "00265A": "DLink",
    "005056": "VMware",
    "0050F2": "Microsoft",
    "00804C": "Brother",
    "00907F": "WatchGuard",
    "00A0C9": "Intel",
    "00E02B": "Extreme",
    "00E08F": "Cisco",
    "090F00": "Fortinet",
    "18B430": "Nest",
    "1CBDB9": "DLink",
    "20E52A": "Netgear",
    "2462AB": "Espressif",
    "2C6BF5": "Juniper",
    "3C0754": "Apple",
    "3C4A92": "HewlettPackard",
    "3C5AB4": "Google",
    "3C8AB0": "Juniper",
    "3CFDFE": "Intel",
    "5057A8": "Cisco",
    "5C63BF": "TPLink",
    "6805CA": "Intel",
    "6CF37F": "Aruba",
    "704CA5": "Fortinet",
    "788A20": "Ubiquiti",
    "7C1E52": "Microsoft",
    "8C8590": "Apple",
    "94577A": "HewlettPackard",
    "94B40F": "Aruba",
    "94C691": "Ubiquiti",
    "A0369F": "Intel",
    "A4CF12": "Espressif",
    "A85C2C": "Apple",
    "B083FE": "Dell",
    "B827EB": "RaspberryPi",
    "DCA632": "RaspberryPi",
    "E0D173": "Cisco",
    "F0189E": "Apple",
    "F4F5E8": "Google",
    "F8BC12": "Dell",
    "FCECDA": "Ubiquiti",
}

_SCHEMA = "oui string, vendor string"
LENGTHS = (9, 7, 6)     # hexadecimal digits of a block's prefix, longest first


def builtin(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BUILTIN.items()), _SCHEMA)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """IEEE registry with columns Assignment and Organization Name."""
    raw = spark.read.option("header", True).csv(path)
    out = raw.select(F.upper(F.trim("Assignment")).alias("oui"),
                     F.trim("Organization Name").alias("vendor"), _row())
    return out.filter(F.length("oui").isin(*LENGTHS) & (F.length("vendor") > 0))


def _row() -> Column:
    """Place of a row in its file, for "the last one counts"."""
    return F.struct(F.input_file_name(), F.monotonically_increasing_id()).alias("_row")


def read_manuf(spark: SparkSession, path: str) -> DataFrame:
    """Text registry: prefix, short name and description separated by blanks. A prefix may
    name its length in bits (28 and 36 for small blocks); without, it is 24."""
    line = F.trim("value")
    parts = F.split(line, r"\s+", 3)
    digits = F.upper(F.regexp_replace(F.substring_index(parts[0], "/", 1), "[^0-9A-Fa-f]", ""))
    bits = F.coalesce(F.expr("try_cast(split_part(split(trim(value), '\\\\s+')[0], '/', 2) AS int)"), F.lit(24))
    rows = spark.read.text(path).select("value", _row()).filter(
        (line != "") & ~F.startswith(line, F.lit("#")) & (F.size(parts) >= 2))
    return (rows.select(F.substr(digits, F.lit(1), (bits / 4).cast("int")).alias("oui"),
                        F.get(parts, F.lit(1)).alias("vendor"), "_row")
            .filter(F.length("oui").isin(*LENGTHS)))


def registry(base: DataFrame, *updates: DataFrame) -> DataFrame:
    """prefix -> vendor; later tables override earlier ones, later rows earlier rows."""
    none = F.lit(None).cast("struct<file: string, row: bigint>").alias("_row")
    tagged = [t.select("oui", "vendor", t["_row"].cast("struct<file: string, row: bigint>").alias("_row")
                       if "_row" in t.columns else none, F.lit(i).alias("_o")) for i, t in enumerate((base, *updates))]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t)
    return union.groupBy("oui").agg(F.max(F.struct("_o", "_row", "vendor"))["vendor"].alias("vendor"))


def with_vendor(df: DataFrame, table: DataFrame | None = None, mac: str = "mac",
                default: str = "unknown") -> DataFrame:
    """Adds ``vendor`` from the hardware address: the longest listed prefix wins. The
    registry size decides the join."""
    table = builtin(df.sparkSession) if table is None else table
    digits = F.upper(F.regexp_replace(normalize_mac(F.col(mac)), ":", ""))
    out, found = df, []
    for n in LENGTHS:
        lookup = table.filter(F.length("oui") == n).select(
            F.col("oui").alias(f"_oui{n}"), F.col("vendor").alias(f"_vendor{n}"))
        out = out.join(lookup, F.substring(digits, 1, n) == F.col(f"_oui{n}"), "left")
        found.append(F.col(f"_vendor{n}"))
    return out.select(*df.columns, F.coalesce(*found, F.lit(default)).alias("vendor"))
