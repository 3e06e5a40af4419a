"""Plain-Python walk of one symbol's candles, as an independent statement of the trade rules."""


def past_close(candles, i, y_ms):
    found = None
    for c in candles[:i]:
        if c["t"] <= candles[i]["t"] - y_ms:
            found = c["close"]
    return found


def window_low(candles, i, window_ms):
    low, at = candles[i]["close"], None
    for c in candles[:i]:
        if c["t"] >= candles[i]["t"] - window_ms and c["close"] < low:
            low, at = c["close"], c["t"]
    return (low, at) if at is not None else (None, None)


def find_exit(candles, i, entry, z, hold_ms):
    high, low = entry, entry
    for j in range(i + 1, len(candles)):
        c = candles[j]
        high, low = max(high, c["high"]), min(low, c["low"])
        drop = (high - c["close"]) / high * 100.0 if high > 0 else 0.0
        if drop >= z:
            return j, "drop-z", high, low
        if c["t"] - candles[i]["t"] >= hold_ms:
            return j, "max-hold", high, low
    j = len(candles) - 1
    return j, "end-of-data", max(high, candles[j]["high"]), min(low, candles[j]["low"])


def walk(candles, x, y_ms, z, hold_ms, slip=0.0, direction="long", dynamic=False):
    """(entry time, exit time, reason, highest, lowest) of each trade."""
    sign = {"long": 1.0, "short": -1.0, "signal-only": 0.0}[direction]
    out, i = [], 0
    while i < len(candles):
        close = candles[i]["close"]
        past = window_low(candles, i, y_ms)[0] if dynamic else past_close(candles, i, y_ms)
        if past is None or past == 0 or (close - past) / past * 100.0 < x:
            i += 1
            continue
        j, reason, high, low = find_exit(candles, i, close * (1.0 + sign * slip), z, hold_ms)
        out.append((candles[i]["t"], candles[j]["t"], reason, high, low))
        i = j + 1
    return out
