"""Bridge memos: a memo is split at its colons and read by a table of grammars; else an address of another chain in it counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utxolens.functions.ledger import let
from utxolens.sources.dims import NETWORKS

# Fixed values of the public memo grammars: heads, the protocol they mean, the form of the fields behind them.
GRAMMARS = (
    (("SWAP", "S", "="), "THORChain", "pool"),  # CHAIN.ASSET:destination[:limit]
    (("MAYAN", "M"), "Maya", "pool"),
    (("SIDESHIFT", "SSH"), "SideShift", "account"),  # destination[:asset] or asset:destination
    (("BRIDGE", "SWAP"), "Bridge", "route"),  # chain:destination[:asset] or destination[:asset]
)
DATA_PREFIX = {"4c": 6, "4d": 8}  # hexadecimal digits before the data, by the length opcode behind 6a
KEY58 = "[1-9A-HJ-NP-Za-km-z]"

def _decoded(text: Column) -> Column:
    """Printable characters of a text that is a data-carrier script, or plain bytes, in hexadecimal; null for other texts."""

    def read(digits: Column) -> Column:
        size = F.substring(digits, 3, 2)
        skip = F.when(~digits.startswith("6a"), 0)
        for opcode, n in DATA_PREFIX.items():
            skip = skip.when(size == opcode, n)
        skip = skip.when(size <= "4b", 4).otherwise(2)
        return F.trim(F.regexp_replace(F.decode(F.unhex(F.substr(digits, skip + 1)), "ISO-8859-1"), "[^ -~]", ""))

    return F.when(text.rlike("^(0x)?([0-9a-fA-F]{2}){5,}$"), let(F.lower(F.regexp_replace(text, "(?i)^0x", "")), read))


def plain(text: Column) -> Column:
    """A memo without its wrapping: hexadecimal decoded where the result reads like a memo, quotes and a RETURN in front gone."""
    chosen = lambda bare: let(_decoded(bare), lambda told: F.when(told.contains(":") | told.startswith("SWAP") | told.startswith("="), told).otherwise(bare))
    return F.trim(F.regexp_replace(F.regexp_replace(let(F.trim(text), chosen), "^[\"']|[\"']$", ""), r"(?i)^(OP_)?RETURN\s+", ""))


def chain_of(address: Column) -> Column:
    """The chain that writes addresses like this one."""
    return F.when(address.startswith("0x"), "ETH").when(address.startswith("T") & (F.length(address) >= 33), "TRX").when(address.rlike(f"^{KEY58}{{32,44}}$"), "SOL").otherwise("UNKNOWN")


def _memo(protocol: str, chain: Column, asset: Column, destination: Column) -> Column:
    parts = (F.lit(protocol), chain, asset, destination)
    return F.struct(*[p.alias(n) for p, n in zip(parts, ("protocol", "chain", "asset", "destination"), strict=True)])


def _word(field: Column) -> Column:
    return F.regexp_extract(field, r"^\w+", 0)


def _asset(field: Column) -> Column:
    return F.coalesce(F.upper(F.nullif(F.regexp_extract(field, r"^[\w-]+", 0), F.lit(""))), F.lit("NATIVE"))


def _pool(protocol: str, fields: list[Column]) -> Column:
    pair = lambda i: F.get(F.split(F.upper(fields[1]), r"\."), F.lit(i))
    fits = fields[1].rlike(r"^[A-Za-z0-9]+\.[\w-]+$")
    return F.when(fits, let(_word(fields[2]), lambda to: F.when(to != "", _memo(protocol, pair(0), pair(1), to))))


def _account(protocol: str, fields: list[Column]) -> Column:
    """Two fields, of which the second is the destination where it looks like an address, else the asset."""
    second = F.when(fields[1].rlike(r"^\w+$"), F.regexp_extract(fields[2], r"^[\w-]+", 0))
    turned = F.coalesce(fields[2].rlike("^(0x|T)") | (F.length(second) > 25), F.lit(False)) & second.isNotNull()
    to = F.when(turned, second).otherwise(_word(fields[1]))
    asset = _asset(F.when(turned, fields[1]).otherwise(second))
    return let(to, lambda a: F.when(a != "", _memo(protocol, chain_of(a), asset, a)))


def _route(protocol: str, fields: list[Column]) -> Column:
    """A destination and an asset, behind the code of a network or without one."""

    def at(to: Column, behind: Column, chain: Column | None) -> Column:
        asset = _asset(F.when(to.rlike(r"^\w+$"), behind))
        return let(_word(to), lambda a: F.when(a != "", _memo(protocol, chain_of(a) if chain is None else chain, asset, a)))

    named = F.upper(fields[1]).isin(*[code for code, _, _ in NETWORKS])
    return F.when(named, at(fields[2], fields[3], F.upper(fields[1]))).otherwise(at(fields[1], fields[2], None))


FORMS = {"pool": _pool, "account": _account, "route": _route}


def _embedded(text: Column) -> list[Column]:
    """Memos that only hold an address: of an EVM chain anywhere, of Tron as a word, of Solana as a word of a memo that speaks of it.

    A memo that starts like a bitcoin address holds neither of the last two. Of Solana a word behind its mention goes first.
    """
    own = ~text.rlike("^(bc1|1|3)")
    words = lambda t, form: F.filter(F.split(t, r"\W+"), lambda w: w.rlike(form))
    evm = F.nullif(F.regexp_extract(text, "0x[0-9a-fA-F]{40}", 0), F.lit(""))
    tron = F.when(own, F.get(words(text, f"^T{KEY58}{{33}}$"), F.lit(0)))
    form = f"^{KEY58}{{32,44}}$"
    behind = F.concat(words(F.regexp_extract(text, r"(?i)sol\w*(.*)$", 1), form), words(text, form))
    sol = F.when(own & text.rlike("(?i)sol") & ~text.rlike("^(0x|T)"), F.get(behind, F.lit(0)))
    found = (("EVM", "ETH", "ERC-20", evm), ("TRON", "TRX", "TRC-20", tron), ("Solana", "SOL", "SPL", sol))
    held = lambda protocol, chain, asset: lambda a: F.when(a.isNotNull(), _memo(protocol, F.lit(chain), F.lit(asset), a))
    return [let(to, held(*told)) for *told, to in found]


def memo(text: Column) -> Column:
    """(protocol, chain, asset, destination) of a bridge memo, or null; the first grammar that fits counts. Null and empty texts are no memos."""

    def read(clean: Column) -> Column:
        def by_grammar(parts: Column) -> Column:
            fields = [F.coalesce(F.get(parts, F.lit(i)), F.lit("")) for i in range(4)]
            return F.coalesce(*[F.when(F.upper(fields[0]).isin(*heads), FORMS[form](protocol, fields)) for heads, protocol, form in GRAMMARS])

        return F.coalesce(let(F.split(clean, ":"), by_grammar), *_embedded(clean))

    return let(plain(text), read)


def with_memo(df: DataFrame, text: str) -> DataFrame:
    """Adds protocol, chain, asset and destination of the bridge memo in column text, or nulls."""
    return df.withColumn("_memo", memo(F.col(text))).select(*df.columns, "_memo.protocol", "_memo.chain", "_memo.asset", "_memo.destination")
