"""Reference dimensions: known entities, bridge providers, swap routers, mix pools and networks, as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values: (pattern of an address, name, category, risk), in the order in which they match.
ENTITIES = (
    ("bc1qxy2k", "Watched address", "watchlist", "high"),
    ("3E8t", "Exchange Deposit (General)", "exchange", "low"),
    ("bc1p", "Taproot Wallet", "taproot", "info"),
    ("1A1zP", "Genesis (Educational)", "historical", "low"),
    ("1L26z", "Garantex Exchange [OFAC]", "sanctioned", "critical"),
    ("14LvL", "Hydra Darknet Market", "darknet", "critical"),
    ("1BtcB", "Blender.io Mixer [OFAC]", "sanctioned", "critical"),
    ("0x12D6", "Tornado Cash Router [OFAC]", "sanctioned", "critical"),
    ("bc1qz9", "Sinbad.io Mixer [OFAC]", "sanctioned", "critical"),
    ("1Suex", "Suex OTC Broker [OFAC]", "sanctioned", "critical"),
    ("1Chat", "Chatex Bot [OFAC]", "sanctioned", "critical"),
    ("1Chip", "ChipMixer Launderer [DOJ/BKA]", "mixer", "critical"),
    ("bc1qa5wk", "FBI Silk Road Seizure Wallet (Individual X)", "seizure", "info"),
    ("bc1qq468", "FBI Colonial Pipeline Ransom Seizure Vault", "seizure", "info"),
    ("bc1qmxay", "DOJ Bitfinex Hack Recovery Vault", "seizure", "info"),
    ("bc1qgermanpolice", "BKA German Federal Police Seizure Vault", "seizure", "info"),
    ("34xp4vRoCGJym3xR7yCVPFHoCNxv4Twseo", "Binance Cold Storage #1", "exchange", "low"),
    ("bc1qm34lsc65zpw79lxes69zkqmk6ee3ewf0j77s3h", "Binance Hot Wallet", "exchange", "low"),
    ("bc1qgdjqv0av3q56jvd82tkdjpy7gdp9ut8tlqmgrpmv24sq90ecnvqqjwvw97", "Bitfinex Cold Storage Vault", "exchange", "low"),
    ("bc1qa2dn50l6k0m2m3wdf3c08z6gq2fsmrwhj5v6d7", "Kraken Cold Storage Vault", "exchange", "low"),
    ("bc1q7cyrfmck2ffu2ud3rn5l5a8yv6f0chkp0zpemf", "Coinbase Prime Custody Vault", "exchange", "low"),
)
PROVIDERS = (
    ("bc1qthor", "THORChain Asgard Vault", "Decentralized Cross-Chain Liquidity Protocol", "critical"),
    ("bc1qmaya", "Maya Protocol Cross-Chain Liquidity", "Decentralized Cross-Chain Liquidity Protocol", "critical"),
    ("3Side", "SideShift AI Router", "Instant No-KYC Cross-Chain Swap", "high"),
    ("bc1qchg", "ChangeNOW Bridge", "Non-Custodial Multi-Currency Exchange", "high"),
    ("1Fixed", "FixedFloat Lightning & Cross-Chain", "Automated Instant Cryptocurrency Exchanger", "high"),
    ("symbiosis", "Symbiosis Protocol", "Decentralized Cross-Chain AMM", "high"),
)
PROVIDER_IDS = ("thorchain", "mayaprotocol", "sideshift", "changenow", "fixedfloat", "symbiosis")
ROUTERS = (
    ("1Fixed", "FixedFloat Instant Swap", "instant-exchanger", "high"),
    ("bc1qchg", "ChangeNOW Non-Custodial", "instant-exchanger", "high"),
    ("3Side", "SideShift AI Router", "instant-exchanger", "high"),
    ("bc1qthor", "ThorChain Asgard Vault", "cross-chain-bridge", "critical"),
    ("1Swap", "SimpleSwap Custodial Bridge", "bridge", "high"),
)
BRIDGE_LABELS = ("bridge", "cross-chain", "instant swap", "chain-hop")
BRIDGE_ADDRESSES = ("bridge", "crosschain")
ROUTER_WORDS = ("swap", "bridge", "cross-chain")
POOLS_SATS = (500_000, 1_000_000, 5_000_000, 10_000_000, 50_000_000)
NETWORKS = (
    ("ETH", "Ethereum", "ERC-20"), ("TRX", "Tron", "TRC-20"), ("SOL", "Solana", "SPL"), ("BSC", "BNB Smart Chain", "BEP-20"), ("ARB", "Arbitrum One", "ERC-20"),
    ("OP", "Optimism", "ERC-20"), ("MATIC", "Polygon", "ERC-20"), ("POL", "Polygon", "ERC-20"), ("XMR", "Monero", "Privacy Coin"), ("AVAX", "Avalanche", "ARC-20"),
)


def rows() -> list[tuple[str, str, str, str, str | None]]:
    """(kind, key, name, category, risk) of all dimensions."""
    patterns = {"entity": ENTITIES, "provider": PROVIDERS, "router": ROUTERS}
    out = [(kind, *row) for kind, table in patterns.items() for row in table]
    out += [("pool", str(sats), f"{sats} sats", "mix-pool", None) for sats in POOLS_SATS]
    return out + [("network", *row, None) for row in NETWORKS]


def frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "kind string, key string, name string, category string, risk string")
