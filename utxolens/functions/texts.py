"""Column expressions over addresses and script templates. One Arrow UDF, where 256-bit numbers need it (network_of)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the address formats.
BASE58 = "^[1-9A-HJ-NP-Za-km-z]+$"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
GENERATORS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
BECH32M = 0x2BC830A3


def polymod(values: Column) -> Column:
    """The checksum register after an array of five-bit values, as a fold."""

    def step(chk: Column, value: Column) -> Column:
        top = F.shiftright(chk, 25)
        new = F.shiftleft(chk.bitwiseAND(0x1FFFFFF), 5).bitwiseXOR(value)
        for i, g in enumerate(GENERATORS):
            new = new.bitwiseXOR(F.when(F.shiftright(top, i).bitwiseAND(1) == 1, F.lit(g)).otherwise(F.lit(0)).cast("long"))
        return new

    return F.aggregate(values, F.lit(1).cast("long"), step)


def segwit_parts(address: Column) -> Column:
    """Five-bit values of a lower-case bc1 address after its separator; -1 for a character outside the alphabet."""
    letters = F.split(F.substring(address, 4, 1000), "")
    letters = F.filter(letters, lambda c: c != "")
    return F.transform(letters, lambda c: (F.instr(F.lit(BECH32), c) - 1).cast("long"))


def with_address_type(df: DataFrame, address: str) -> DataFrame:
    """Adds type: the kind of a valid mainnet address, or 'invalid: ' and the reason. Null and blank are 'invalid: empty'."""
    own = df.withColumn("_text", F.trim(F.col(address))).withColumn("_low", F.lower("_text"))
    own = own.withColumn("_values", F.when(F.col("_low").startswith("bc1"), segwit_parts(F.col("_low"))))
    own = own.withColumns({"_check": polymod(F.concat(F.array(*[F.lit(x).cast("long") for x in (3, 3, 0, 2, 3)]), F.col("_values"))), "_version": F.get("_values", F.lit(0)), "_bits": (F.size("_values") - 7) * 5})
    own = own.withColumns({"_bytes": F.floor(F.col("_bits") / 8), "_spare": F.col("_bits") % 8, "_last": F.get("_values", F.size("_values") - 7)})
    text, low, version, check, n8, spare = (F.col(c) for c in ("_text", "_low", "_version", "_check", "_bytes", "_spare"))
    padded = (spare >= 5) | (F.col("_last") % F.pow(F.lit(2), spare).cast("long") != 0)
    segwit = (
        F.when(F.length(text) > 90, "invalid: length").when((text != low) & (text != F.upper(text)), "invalid: mixed case").when((F.size("_values") < 7) | F.substring(low, 4, 1000).contains("1"), "invalid: structure")
        .when(F.array_min("_values") < 0, "invalid: character").when(version > 16, "invalid: version").when(padded | (n8 < 2) | (n8 > 40), "invalid: program")
        .when(check != F.when(version == 0, 1).otherwise(BECH32M), "invalid: checksum").when(((version == 0) & ~n8.isin(20, 32)) | ((version == 1) & (n8 != 32)), "invalid: program size")
        .when(version == 1, "taproot").when((version == 0) & (n8 == 32), "segwit script").when(version == 0, "segwit").otherwise(F.concat(F.lit("segwit v"), version.cast("string")))
    )
    ok58 = text.rlike(BASE58) & F.length(text).between(26, 35)
    old = F.when(~ok58, "invalid: characters or length").when(text.startswith("1"), "legacy").otherwise("script")
    kind = F.when(F.coalesce(text, F.lit("")) == "", "invalid: empty").when(low.startswith("bc1"), segwit).when(text.startswith("1") | text.startswith("3"), old).otherwise("invalid: unknown")
    return own.withColumn("type", kind).select(*df.columns, "type")


def network_of(address: Column) -> Column:
    """The network that writes addresses like this one. A Base58 text is Solana's if it decodes to exactly 32 bytes."""

    @F.pandas_udf(T.BooleanType())
    def is_key(texts: pd.Series) -> pd.Series:
        digits = {c: i for i, c in enumerate("123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz")}

        def width(text: str) -> int:
            number = 0
            for c in text:
                number = number * 58 + digits[c]
            return (number.bit_length() + 7) // 8 + len(text) - len(text.lstrip("1"))

        return pd.Series([t is not None and width(t) == 32 for t in texts], dtype=bool)

    form = F.when(address.rlike("^[1-9A-HJ-NP-Za-km-z]{32,44}$"), address)
    return F.when(address.rlike("^0x[0-9a-fA-F]{40}$"), "EVM").when(address.rlike("^T[1-9A-HJ-NP-Za-km-z]{33}$"), "TRON").when(address.rlike("^(bc1|[13])"), "BTC").when(is_key(form), "SOL").otherwise("none")


def printable(hexes: Column) -> Column:
    """Hex as ASCII with dots for other bytes; null with fewer than two printable characters."""
    text = F.regexp_replace(F.decode(F.unhex(hexes), "ISO-8859-1"), "[^ -~]", ".")
    return F.when(F.length(F.replace(text, F.lit("."), F.lit(""))) >= 2, text)


def carried_text(script_hex: Column) -> Column:
    """The text in a data-carrier script: all bytes after the opcode, or after one byte more."""
    body = F.substring(script_hex, 3, 1_000_000)
    return F.when(script_hex.startswith("6a"), F.coalesce(printable(body), printable(F.substring(body, 3, 1_000_000))))


def template(script_hex: Column) -> Column:
    """The standard form of an output script."""
    rules = (("^76a914[0-9a-f]{40}88ac$", "legacy"), ("^a914[0-9a-f]{40}87$", "script hash"), ("^0014[0-9a-f]{40}$", "segwit"), ("^0020[0-9a-f]{64}$", "segwit script"), ("^5120[0-9a-f]{64}$", "taproot"), ("^6a", "data"), ("^(41|21)[0-9a-f]+ac$", "bare key"))  # fixed values
    return F.coalesce(*[F.when(script_hex.rlike(p), n) for p, n in rules], F.lit("custom"))
