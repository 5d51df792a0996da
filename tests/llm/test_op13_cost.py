"""op13: the battery's cost grows with a token's length, not its cube; gates spare texts and lose no match."""

import math
import random
import time

from pyspark.sql import functions as F

from furnacelens.llm import op13_secrets as op13


def _upper(z):
    x = abs(z) / math.sqrt(2.0)
    t = 1 / (1 + 0.3275911 * x)
    half = 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * math.exp(-x * x)
    return half if z >= 0 else 1 - half


def _battery(token):
    n = float(len(token))
    enc = "hex" if not set(token) - set("0123456789abcdef") or not set(token) - set("0123456789ABCDEF") else "alnum" if token.isalnum() else "base64"
    size, counts = op13.ALPHABETS[enc]
    share = [c / size for c in counts]
    s = float(sum(token.count(c) ** 2 for c in set(token)))
    repeat = (s - (n + n * (n - 1) / size)) / math.sqrt(2 * n * (n - 1) * (size - 1) / (size * size))
    cls = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in token]
    q, cube = 1 - sum(x * x for x in share), sum(x * (1 - x) ** 2 for x in share)
    runs = ((n - 1) * q - sum(x != y for x, y in zip(cls, cls[1:]))) / math.sqrt(max((n - 1) * q * (1 - q) + 2 * (n - 2) * (cube - q * q), 1e-12))
    mean = sum(map(ord, token)) / n
    dev = [ord(c) - mean for c in token]
    den = sum(x * x for x in dev)
    r = sum(x * y for x, y in zip(dev, dev[1:])) / den if den > 0 else 1.0
    return enc, min(1.0, 3 * min(_upper(repeat), _upper(runs), 2 * _upper(abs(r + 1 / n) * math.sqrt(n))))


def test_battery_of_short_and_long_tokens(spark):
    rng = random.Random(3)
    tokens = ["".join(rng.choices(alphabet, k=k)) for alphabet in ("0123456789abcdef", "abcXYZ019", op13.CANDIDATE) for k in (20, 33, 64, 150, 2000)]
    tokens += ["a" * 30, "Ab" * 20, "=" * 25]
    rows = spark.createDataFrame([(t,) for t in tokens], "token string").repartition(1)
    started = time.perf_counter()
    got = {r.token: r.t for r in rows.select("token", op13.battery(F.col("token")).alias("t")).collect()}
    assert time.perf_counter() - started < 60  # with neighbours looked up by position 2,000 characters took hours
    for t in tokens:
        enc, p = _battery(t)
        assert got[t].enc == enc and math.isclose(got[t].p, p, rel_tol=1e-9, abs_tol=1e-15), t


def test_gates_lose_no_match(spark):
    rng = random.Random(4)
    parts = ["PASSWORD: abcdefghijkl", "api_key='0123456789abcdef'", "ApiKey = x", "toKen=abcdefghijklmn", "AKIA" + "Z9" * 8, "0123456789abcdef", "e" * 15, "x" * 19, "x" * 20, "-_" * 11, "é", " ", "\n", "plain", "abc/"]
    texts = ["", None] + ["".join(rng.choices(parts, k=rng.randint(1, 6))) for _ in range(200)]
    text = F.coalesce(F.col("text"), F.lit(""))
    patterns = {"assign": op13.ASSIGN, "access": op13.ACCESS, "hex": op13.HEX, "random": "[A-Za-z0-9+/_=-]{20,}"}
    named = {"assign": op13.ASSIGN_AHEAD, "access": op13.ACCESS, "hex": op13.HEX_NAMED, "random": f"[{op13.CANDIDATE}]{{20,}}"}
    gates = op13._gates(text, 16)
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    every = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    for k, p in patterns.items():
        got = rows.select(gates[k].alias("gate"), every(p).alias("a"), every(named[k]).alias("b")).collect()
        assert any(r.a for r in got) and not any(r.a and not r.gate or r.a != r.b for r in got), k
        assert not all(r.gate for r in got), k
