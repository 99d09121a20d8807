"""Column helpers for trades: parsing, symbols, identities, hashes. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming removes.
SPACE = " \t\n\r\x0b\x0c\x85\xa0"
#: Quote assets that make a token a market symbol.
QUOTE_ASSETS = (
    "USDT", "USDC", "BUSD", "FDUSD", "TUSD", "DAI", "EUR", "GBP", "AUD", "TRY", "BRL", "JPY", "RUB", "NGN", "ZAR", "PLN", "CZK",
    "UAH", "BTC", "ETH", "BNB", "XRP", "SOL", "PAX", "USDP", "VAI", "BIDR", "BVND",
)
#: Fixed value: the name space of the DNS in version 5 UUIDs.
NAMESPACE_DNS = "6ba7b8109dad11d180b400c04fd430c8"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACE))


def normalize_symbol(symbol: Column) -> Column:
    """Trimmed, upper-case, without ``-``, ``/`` and ``_``."""
    return F.translate(F.upper(strip(symbol)), "-/_", "")


def upper_symbol(symbol: Column) -> Column:
    """Trimmed and upper-case only."""
    return F.upper(strip(symbol))


def normalize_exchange(exchange: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(strip(exchange)), F.lit("")), F.lit("unknown"))


def side_of_maker(is_buyer_maker: Column) -> Column:
    """A buyer that made the order was sold to."""
    return F.when(is_buyer_maker, "SELL").otherwise("BUY")


def is_finite(x: Column) -> Column:
    """False for NaN, infinities and null."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def signed_ofi(side: Column, quantity: Column, price: Column) -> Column:
    """Quantity of a buy, minus that of a sale; 0 for other sides and for values that are no sizes or prices."""
    good = is_finite(quantity) & (quantity > 0) & is_finite(price)
    s = F.upper(strip(side))
    return F.when(good & (s == "BUY"), quantity).when(good & (s == "SELL"), -quantity).otherwise(F.lit(0.0))


def parse_number(text: Column) -> Column:
    """A decimal number, NaN or an infinity by name; null for anything else, and for numbers beyond a double."""
    t = strip(text)
    value = t.try_cast("double")
    by_name = F.lower(t).rlike(r"^([+-]?inf(inity)?|nan)$")
    return F.when(t.rlike(NUMBER) & (F.abs(value) < float("inf")), value).when(by_name, value)


def parse_time_ms(text: Column) -> Column:
    """Epoch seconds (below 1e11), epoch milliseconds, or a date and time, to milliseconds; null for anything else."""
    t = strip(text)
    whole = F.when(t.rlike("^[+-]?[0-9]+$"), t.try_cast("long"))
    real = F.when(t.rlike(NUMBER), t.try_cast("double"))
    dated = F.when(
        t.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$") | t.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(\.\d+)?$"),
        F.unix_millis(t.try_cast("timestamp")),
    )
    return F.coalesce(
        F.when(whole < 10**11, whole * 1000).otherwise(whole),
        F.when(real < 1e11, (real * 1000).cast("long")).otherwise(real.cast("long")),
        dated,
    )


def parse_flag(text: Column) -> Column:
    """True for 1, t, true, y and yes in any case; false for anything else, null included."""
    return F.coalesce(F.lower(strip(text)).isin("1", "t", "true", "y", "yes"), F.lit(False))


def quote_quantity(given: Column, price: Column, quantity: Column) -> Column:
    """What was given, if positive; else price times quantity."""
    return F.when(~F.isnan(given) & (given > 0), given).otherwise(price * quantity)


def partition_key(exchange: Column, symbol: Column) -> Column:
    return F.concat(exchange, F.lit(":"), symbol)


def routing_key(exchange: Column, symbol: Column, key: Column | None = None) -> Column:
    """``trade.<exchange>.<symbol>``; missing parts come from ``key`` ("exchange:symbol"), else are ``unknown``."""
    e, s = F.nullif(exchange, F.lit("")), F.nullif(F.lower(symbol), F.lit(""))
    if key is not None:
        usable = (e.isNull() | s.isNull()) & key.contains(":")
        e, s = (
            F.when(usable, F.nullif(F.substring_index(key, ":", 1), F.lit(""))).otherwise(e),
            F.when(usable, F.nullif(F.lower(F.regexp_replace(key, "^[^:]*:", "")), F.lit(""))).otherwise(s),
        )
    return F.concat(F.lit("trade."), F.coalesce(e, F.lit("unknown")), F.lit("."), F.coalesce(s, F.lit("unknown")))


def lag_ms(ingested: Column, traded: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), ingested - traded)


def backoff_ms(attempt: Column, base: int, most: int) -> Column:
    """``base`` doubled ``attempt`` times, ``most`` at the most."""
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), attempt)).cast("long")


def header_map(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])


def sorted_headers(headers: Column) -> Column:
    return F.array_sort(F.map_entries(headers))


def uuid5_dns(name: Column) -> Column:
    """The version 5 UUID of a name in the name space of the DNS."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_DNS)), name.cast("binary")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, 1)
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3))]
    return F.concat_ws("-", *parts, F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def repair_uuid(text: Column) -> Column:
    """A UUID in canonical form; of any other text, its version 5 UUID; a fresh one for null and blank."""
    t = F.lower(strip(text))
    digits = F.regexp_replace(F.regexp_replace(t, r"^urn:uuid:|[{}]", ""), "-", "")
    canonical = F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(F.coalesce(t, F.lit("")) == "", F.uuid()).when(digits.rlike("^[0-9a-f]{32}$"), canonical).otherwise(uuid5_dns(text))


def fnv1a_32(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a text's UTF-8 bytes, as a long."""
    h = F.hex(text.cast("binary"))
    byte = lambda i: F.conv(F.substring(h, 2 * i - 1, 2), 16, 10).cast("long")
    places = F.when(F.length(h) > 0, F.sequence(F.lit(1), (F.length(h) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(
        places,
        F.lit(2166136261).cast("long"),
        lambda a, i: (a.bitwiseXOR(byte(i)) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF)),
    )


def shard(symbol: Column, workers: int) -> Column:
    """The worker of a symbol: its normalised form's FNV-1a hash modulo their number."""
    return (fnv1a_32(normalize_symbol(symbol)) % workers).cast("int") if workers > 1 else F.lit(0)


def alert_time(timestamp: Column, alerted_at_ms: Column) -> Column:
    """A stated time, else milliseconds, else now."""
    return F.coalesce(timestamp.try_cast("timestamp"), F.timestamp_millis(alerted_at_ms), F.current_timestamp())


def round_to(price: Column, tick: float) -> Column:
    """To the nearest multiple of ``tick`` (1e-8 if that isn't positive)."""
    step = tick if tick > 0 else 1e-8
    return F.round(price / step) * step


def round_half_even(x: Column, places: int) -> Column:
    """``x`` to ``places`` decimals by its exact binary value, ties to even.

    The product with 10**places is taken in two exact halves, so that a value
    just beside a tie is not mistaken for one. Null, NaN and infinities stay, as
    do values too large to have such decimals.
    """
    scale = float(10**places)
    far = x * F.lit(134217729.0)  # 2**27 + 1: splits the value into halves
    high = far - (far - x)
    low = x - high
    n = F.rint(high * scale + low * scale)
    rest = (high * scale - n) + low * scale
    odd = F.pmod(n, F.lit(2.0)) == 1
    up, down = (rest > 0.5) | ((rest == 0.5) & odd), (rest < -0.5) | ((rest == -0.5) & odd)
    exact = (n + F.when(up, 1.0).when(down, -1.0).otherwise(0.0)) / scale
    return F.when(F.abs(x) < 2.0**52 / scale, exact).otherwise(x)


def trade_headers() -> Column:
    """The headers of a trade's message, from the columns of schema TRADE."""
    names = ("schema_version", "event_id", "exchange", "symbol", "source", "side", "trade_time_ms", "ingested_at_ms")
    pairs = [y for n in names for y in (F.lit(n), F.coalesce(F.col(n).cast("string"), F.lit("")))]
    return F.create_map(*pairs, F.lit("content-type"), F.lit("application/json"))


def notification(side: Column, z: Column, price: Column) -> Column:
    return F.concat(side, F.lit(" · Z "), F.format_string("%.2f", z), F.lit("\nPrice: $"), F.format_string("%,.2f", price))


def looks_like_symbol(token: Column) -> Column:
    """5 to 14 capitals and digits that end in a quote asset and are longer than it."""
    return token.rlike("^[A-Z0-9]{5,14}$") & token.rlike("^.+(" + "|".join(QUOTE_ASSETS) + ")$")


def symbol_of_path(path: Column, symbols: list[str]) -> Column:
    """The symbol that a file's name starts with: one configured, or one that looks like a symbol; else the first configured."""
    name = F.upper(F.substring_index(path, "/", -1))
    known = [s.upper().translate(str.maketrans("", "", "-/_")) for s in symbols]
    found = []
    for sep in "-_.":
        at = F.instr(name, sep)
        token = normalize_symbol(F.substring(name, F.lit(1), at - 1))
        found.append(F.when((at > 4) & (token.isin(known) | looks_like_symbol(token)), token))
    return F.coalesce(*found, F.lit(known[0] if known else "BTCUSDT"))
