"""Lookups, thresholds and column lists that results depend on."""

# Chain name (lower case) -> numeric code; anything else is 99.
CHAIN_CODES = {
    "ethereum": 0,
    "solana": 1,
    "polygon": 2,
    "base": 3,
    "avalanche": 4,
    "arbitrum": 5,
    "optimism": 6,
    "bnb": 7,
    "blast": 8,
}
UNKNOWN_CHAIN_CODE = 99

# Chain name (lower case) -> symbol of the currency it settles in.
CHAIN_SYMBOLS = {
    "ethereum": "ETH",
    "base": "ETH",
    "polygon": "MATIC",
    "solana": "SOL",
    "arbitrum": "ARB",
    "optimism": "OP",
    "bnb": "BNB",
    "blast": "BLAST",
}
MACRO_SYMBOL = "BTC"

# Market mood and its direction.
MOOD_CODES = {"POSITIVE": 1, "NEUTRAL": 0, "NEGATIVE": -1}
TREND_CODES = {"UP": 1, "STABLE": 0, "DOWN": -1}

# Entity sentiment category -> symbol.
CATEGORY_SYMBOLS = {
    "EXTREMELY_BULLISH": "🚀🚀",
    "BULLISH": "📈",
    "NEUTRAL": "➡️",
    "BEARISH": "📉",
    "EXTREMELY_BEARISH": "🔴🔴",
}
UNKNOWN_CATEGORY_SYMBOL = "❓"

# Predicted class -> signal text.
SIGNAL_TEXT = {1: "BUY", 0: "HOLD", -1: "SELL"}

# Moving-average spans (days) -> largest number of missing days allowed.
SMA_SPANS = {20: 1, 50: 3, 100: 5, 200: 10}

# Chart period (days) from which each average is drawn.
CHART_SPANS = {20: 30, 50: 90, 100: 180, 200: 180}

# Defaults of a parsed model reply.
MARKET_REPLY_DEFAULTS = {
    "hype_score": 0, "sentiment": "NEUTRAL", "trend": "STABLE", "keywords": "", "summary": "",
}
ENTITY_REPLY_DEFAULTS = {
    "sentiment_score": 0, "sentiment_category": "NEUTRAL", "bullish_indicators": "",
    "bearish_indicators": "", "key_topics": "", "community_engagement": 5, "volume_activity": 5,
}

# Model features, in matrix order.
FEATURES = [
    "ret_3d", "ret_7d", "ret_14d", "ret_30d",
    "vol_7d", "vol_14d", "vol_30d",
    "floor_vs_ma20", "floor_vs_ma50", "floor_vs_ma200",
    "spread_20_50", "spread_50_200", "ma20_slope", "ma50_slope",
    "listing_ratio", "owner_ratio",
    "sale_count_ma7", "sale_vol_ma7", "sale_count_momentum",
    "intraday_range",
    "ranking",
    "hype_score", "hype_sentiment", "hype_trend",
    "xsent_score", "xsent_engagement", "xsent_volume",
    "fear_greed_value", "fear_greed_change_7d",
    "native_ret_1d", "native_ret_7d", "native_ret_30d",
    "native_vol_7d", "native_ath_pct", "native_volume_rel",
    "btc_ret_7d", "btc_vol_7d", "btc_ath_pct",
    "chain_enc",
]
