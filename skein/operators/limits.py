"""Rate limits, token buckets, circuit breakers and backoff. One step function per automaton serves batch and stream."""

from __future__ import annotations

from collections import deque
from fractions import Fraction
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.sequences import Automaton, in_order
from skein.schema import BackoffConfig, BreakerConfig, LimiterConfig


def client_key(api_key: Column, host: Column) -> Column:
    return F.when(F.coalesce(api_key, F.lit("")) != "", F.concat(F.lit("key:"), F.left(api_key, F.lit(20)))).otherwise(F.concat(F.lit("ip:"), host))


def tumbling(requests: DataFrame, limit: int, seconds: int = 60, key: str = "client", ts: str = "ts", order: str = "id") -> DataFrame:
    """Adds window (number of the fixed window), n (place in it) and allowed (n <= limit). Groups are bounded by time."""
    window = F.floor(F.unix_micros(ts) / (seconds * 1_000_000)).cast("long")
    numbered = requests.withColumn("window", window)
    n = F.row_number().over(Window.partitionBy(key, "window").orderBy(ts, order))
    return numbered.withColumn("n", n).withColumn("allowed", F.col("n") <= limit)


class Anchor(NamedTuple):
    start: float
    n: int


def anchored_step(state: Anchor | None, at: float, limit: int, seconds: float = 60.0) -> tuple[Anchor, bool]:
    """Windows begin at a client's first request and again once they are over."""
    if state is None or at - state.start >= seconds:
        state = Anchor(at, 0)
    return Anchor(state.start, state.n + 1), state.n + 1 <= limit


class Bucket(NamedTuple):
    tokens: float
    at: float


def bucket_step(state: Bucket | None, at: float, wanted: float, rate: float, capacity: float) -> tuple[Bucket, bool, float | None]:
    """(state, taken, seconds to wait if not): refill, then take if there is enough. None: it can never be taken."""
    tokens = capacity if state is None else min(capacity, state.tokens + max(0.0, at - state.at) * rate)
    if tokens >= wanted:
        return Bucket(tokens - wanted, at), True, 0.0
    return Bucket(tokens, at), False, (wanted - tokens) / rate if wanted <= capacity else None


#: Fixed value: the longest wait for tokens in seconds.
LONGEST_WAIT = 300.0


class RateLimited(Exception):
    """Too few tokens. retry_after: whole seconds until there are enough."""

    def __init__(self, retry_after: int):
        super().__init__(f"rate limit exceeded, retry after {retry_after} s")
        self.retry_after = retry_after


def consume(state: Bucket, wanted: float, rate: float) -> Bucket:
    """Take without a refill, or raise."""
    if state.tokens < wanted:
        raise RateLimited(int((wanted - state.tokens) / rate) + 1)
    return state._replace(tokens=state.tokens - wanted)


def waiting(tokens: Column, wanted: Column, rate: float, waited: Column | None = None) -> Column:
    """Seconds until a bucket holds as many tokens as wanted, none of which are taken; null where the wait, with what was
    waited already, would exceed LONGEST_WAIT."""
    wait = F.greatest(F.lit(0.0), (wanted - tokens) / rate)
    return F.when(wait + (F.lit(0.0) if waited is None else waited) <= LONGEST_WAIT, wait)


class Providers:
    """Limits by provider: the refill follows the tighter of its two rates. An unknown provider is an error."""

    def __init__(self, configs: dict[str, LimiterConfig]):
        self.configs = dict(configs)
        self.state: dict[str, Bucket] = {}

    def _config(self, name: str) -> LimiterConfig:
        if name not in self.configs:
            raise ValueError(f"unknown provider: {name}")
        return self.configs[name]

    def register(self, name: str, config: LimiterConfig) -> None:
        self.configs[name] = config
        self.state.pop(name, None)

    def acquire(self, name: str, at: float, wanted: float = 1.0) -> tuple[bool, float | None]:
        """(taken, seconds to wait if not; None: never)."""
        c = self._config(name)
        self.state[name], taken, wait = bucket_step(self.state.get(name), at, wanted, c.refill_per_second, c.burst)
        return taken, wait

    def status(self, name: str) -> dict[str, float]:
        c = self._config(name)
        tokens = self.state[name].tokens if name in self.state else float(c.burst)
        return {"tokens": tokens, "capacity": float(c.burst), "refill_per_second": c.refill_per_second, "share": tokens / c.burst}

    def reset(self, name: str | None = None) -> None:
        """One provider's bucket is full again, or all are."""
        for x in [name] if name else list(self.configs):
            self._config(x)
            self.state.pop(x, None)

    def table(self, spark) -> DataFrame:
        """(provider, capacity, refill_per_second), to join with requests."""
        return spark.createDataFrame([(n, float(c.burst), c.refill_per_second) for n, c in self.configs.items()], "provider string, capacity double, refill_per_second double")


class Breaker(NamedTuple):
    state: str = "closed"
    failures: int = 0
    successes: int = 0
    opened: float = 0.0
    trials: int = 0


def breaker_step(b: Breaker | None, at: float, succeeded: bool, c: BreakerConfig) -> tuple[Breaker, bool]:
    """(state, whether the call was let through). Its outcome counts only if it was."""
    b = b or Breaker()
    if b.state == "open":
        if at - b.opened < c.recovery_seconds:
            return b, False
        b = Breaker("half_open", b.failures, 0, b.opened, 0)
    if b.state == "half_open":
        if b.trials >= c.trials:
            return b, False
        b = b._replace(trials=b.trials + 1)
        if not succeeded:
            return b._replace(state="open", opened=at, failures=b.failures + 1), True
        won = b.successes + 1
        return (Breaker() if won >= c.successes else b._replace(successes=won)), True
    if succeeded:
        return b._replace(failures=0, successes=b.successes + 1), True
    failures = b.failures + 1
    return (b._replace(state="open", failures=failures, opened=at) if failures >= c.failures else b._replace(failures=failures)), True


class Breakers:
    """Breakers by name. Registering a name again changes nothing; an unknown name is an error."""

    def __init__(self):
        self.known: dict[str, tuple[BreakerConfig, Breaker]] = {}

    def register(self, name: str, config: BreakerConfig | None = None) -> None:
        self.known.setdefault(name, (config or BreakerConfig(), Breaker()))

    def call(self, name: str, at: float, succeeded: bool) -> bool:
        """Whether the call was let through."""
        config, state = self._of(name)
        state, admitted = breaker_step(state, at, succeeded, config)
        self.known[name] = config, state
        return admitted

    def status(self, name: str) -> Breaker:
        return self._of(name)[1]

    def reset(self) -> None:
        self.known = {n: (c, Breaker()) for n, (c, _) in self.known.items()}

    def _of(self, name: str) -> tuple[BreakerConfig, Breaker]:
        if name not in self.known:
            raise ValueError(f"unknown breaker: {name}")
        return self.known[name]


class Merging:
    """Nodes that become one another, and bounds that lead to nodes: a start in (bound before, bound] leads where bound does."""

    def __init__(self):
        self.after: list[int] = []
        self.bounds: list[int] = []
        self.leads: list[int] = []
        self.first: int | None = None

    def node(self) -> int:
        self.after.append(len(self.after))
        return len(self.after) - 1

    def new_bound(self, bound: int) -> bool:
        """Whether earlier starts up to bound weren't led anywhere yet. No start is later than the first row."""
        return not self.bounds or self.bounds[-1] < self.first and bound > self.bounds[-1]

    def ends(self) -> np.ndarray:
        """What each node became; a node becomes later ones only."""
        out = np.arange(len(self.after))
        for k in range(len(out) - 1, -1, -1):
            out[k] = out[self.after[k]]
        return out

    def bounds_and_ends(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Only the last of neighbouring bounds that lead to the same node."""
        lead = ends[self.leads]
        last = np.append(lead[1:] != lead[:-1], True)
        return np.array(self.bounds)[last], lead[last]


class AnchorEffect:
    """Where windows lead over rows whose first window began earlier. A start is over at one row, where a new window begins;
    windows that end at the same row are one from there on."""

    def __init__(self, length: int):
        self.length, self.rows = length, 0
        self.known = Merging()
        self.begun: list[tuple[int, int]] = []
        self.open: deque[int] = deque()

    def feed(self, row: tuple) -> None:
        at, known = row[0], self.known
        known.first = at if known.first is None else known.first
        ended = []
        while self.open and at - self.begun[self.open[0]][0] >= self.length:
            ended.append(self.open.popleft())
        bound = at - self.length
        released = known.new_bound(bound)
        if ended or released:
            new = known.node()
            self.begun.append((at, self.rows))
            self.open.append(new)
            for k in ended:
                known.after[k] = new
            if released:
                known.bounds.append(bound)
                known.leads.append(new)
        self.rows += 1

    def __getstate__(self) -> tuple:
        bounds, lead = self.known.bounds_and_ends(self.known.ends())
        begun = np.array(self.begun)[lead]
        return self.rows, bounds, begun[:, 0], self.rows - begun[:, 1]

    def __setstate__(self, state: tuple) -> None:
        self.rows, self.bounds, self.starts, self.counts = state

    def end(self, state: Anchor | None) -> Anchor:
        k = 0 if state is None else int(np.searchsorted(self.bounds, state.start))
        return Anchor(int(self.starts[k]), int(self.counts[k])) if k < len(self.bounds) else Anchor(state.start, state.n + self.rows)


class Units(NamedTuple):
    """A bucket in whole numbers: units of a token, units that a microsecond brings, units that fit."""

    token: int
    gain: int
    most: int

    @classmethod
    @lru_cache(maxsize=4096)
    def of(cls, rate: float, capacity: float) -> Units:
        """The rate as a fraction of small terms, so that sums don't depend on the order of additions."""
        share = Fraction(rate).limit_denominator(max(1, min(10**6, int(2**60 / (1e6 * max(capacity, 1.0))))))
        token = share.denominator * 10**6
        return cls(token, share.numerator, round(capacity * token))

    def wanted(self, tokens: float | None) -> int:
        return round(min(float(tokens or 0), self.most / self.token + 1) * self.token)

    def filled(self, tokens: int, microseconds: int) -> int:
        return self.most if self.gain and microseconds > self.most // self.gain else min(self.most, tokens + max(0, microseconds) * self.gain)


def units_step(state: Bucket | None, row: tuple) -> tuple[Bucket, bool, float | None, float]:
    """bucket_step in whole units; row: (microseconds, tokens, rate, capacity)."""
    at, tokens, rate, capacity = row
    u = Units.of(rate, capacity)
    had = u.most if state is None else u.filled(state.tokens, at - state.at)
    wanted = u.wanted(tokens)
    if had >= wanted:
        return Bucket(had - wanted, at), True, 0.0, (had - wanted) / u.token
    wait = (wanted - had) / u.gain / 1e6 if wanted <= u.most and u.gain else None
    return Bucket(had, at), False, wait, had / u.token


class BucketEffect:
    """What a bucket holds after a range as a function of what it held at the range's first row: pieces that either grow with it
    or are constant. A full bucket makes pieces constant; pieces that continue each other are one again."""

    def __init__(self):
        self.first: int | None = None

    def feed(self, row: tuple) -> None:
        at, tokens, rate, capacity = row
        if self.first is None:
            self.u, self.first, self.at = Units.of(rate, capacity), at, at
            self.lo, self.out, self.slope = (np.array([x], dtype=np.int64) for x in (0, 0, 1))
        most, wanted = self.u.most, self.u.wanted(tokens)
        gain = self.u.filled(0, at - self.at)
        self.at = at
        value = self.out + gain
        rise = self.slope == 1
        if rise.any():
            ends = np.append(self.lo[1:] - 1, most)
            to = value + (ends - self.lo)
            cuts = [(self.lo + (level - value))[rise & (value < level) & (to >= level)] for level in (wanted, most)]
            lo = np.unique(np.concatenate([self.lo, *cuts]))
            k = np.searchsorted(self.lo, lo, side="right") - 1
            value = value[k] + self.slope[k] * (lo - self.lo[k])
            self.lo, self.slope = lo, self.slope[k]
        self.slope = np.where(value >= most, 0, self.slope)
        value = np.minimum(value, most)
        self.out = np.where(value >= wanted, value - wanted, value)
        if len(self.lo) > 1:
            goes_on = (self.slope[1:] == self.slope[:-1]) & (self.out[1:] == self.out[:-1] + self.slope[:-1] * (self.lo[1:] - self.lo[:-1]))
            new = np.append(True, ~goes_on)
            self.lo, self.out, self.slope = self.lo[new], self.out[new], self.slope[new]

    def end(self, state: Bucket | None) -> Bucket:
        x = self.u.most if state is None else self.u.filled(state.tokens, self.first - state.at)
        k = int(np.searchsorted(self.lo, x, side="right")) - 1
        return Bucket(int(self.out[k] + self.slope[k] * (x - self.lo[k])), self.at)


def plain_breaker(b: Breaker | None) -> Breaker:
    """The breaker with only those numbers that decide what it does next."""
    b = b or Breaker()
    if b.state == "closed":
        return Breaker(failures=b.failures)
    return Breaker("open", opened=b.opened) if b.state == "open" else Breaker("half_open", successes=b.successes, trials=b.trials)


class BreakerEffect:
    """Where all states lead at once: the few of a closed or half open breaker, and those of one opened earlier, which differ by
    the row at which it is tried again. States that meet are one from there on."""

    def __init__(self, step):
        self.step = step
        self.known = Merging()

    def _begin(self, row: tuple) -> None:
        c = _breaker_config(*row[2:])
        starts = [Breaker(failures=f) for f in range(c.failures)] + [Breaker("half_open", successes=s, trials=t) for s in range(c.successes) for t in range(c.trials + 1)]
        self.known.first, self.wait = row[0], c.recovery_seconds
        self.nodes = {b: self.known.node() for b in starts}
        self.states: dict[Breaker, int] = dict(self.nodes)
        self.open: deque[tuple[int, int]] = deque()

    def feed(self, row: tuple) -> None:
        if self.known.first is None:
            self._begin(row)
        known, at = self.known, row[0]
        due = list(self.states.items())
        while self.open and at - self.open[0][0] >= self.wait:
            due.append((Breaker("open", opened=self.open[0][0]), self.open.popleft()[1]))
        bound = at - self.wait
        if known.new_bound(bound):
            known.bounds.append(bound)
            known.leads.append(known.node())
            due.append((Breaker("open", opened=bound), known.leads[-1]))
        self.states = {}
        for b, node in due:
            after = plain_breaker(self.step(b, row)[0])
            if after.state == "open" and self.open and self.open[-1][0] == at:
                self._one(node, self.open, (at,))
            elif after.state == "open":
                self.open.append((at, node))
            elif after in self.states:
                self._one(node, self.states, after)
            else:
                self.states[after] = node

    def _one(self, node: int, among, at) -> None:
        """The node and that which is in the same state are a new one."""
        new = self.known.node()
        other = among[-1][1] if among is self.open else among[at]
        self.known.after[node] = self.known.after[other] = new
        if among is self.open:
            among[-1] = (at[0], new)
        else:
            among[at] = new

    def __getstate__(self) -> tuple:
        ends = self.known.ends()
        state_of = {node: b for b, node in self.states.items()} | {node: Breaker("open", opened=at) for at, node in self.open}
        bounds, lead = self.known.bounds_and_ends(ends)
        return {b: state_of[int(ends[n])] for b, n in self.nodes.items()}, bounds, [state_of[int(n)] for n in lead]

    def __setstate__(self, state: tuple) -> None:
        self.nodes, self.bounds, self.leads = state

    def end(self, state: Breaker | None) -> Breaker:
        b = plain_breaker(state)
        if b.state != "open":
            return self.nodes[b]
        k = int(np.searchsorted(self.bounds, b.opened))
        return self.leads[k] if k < len(self.bounds) else b


def anchored(requests: DataFrame, limit: int, seconds: float = 60.0, key: str = "client", ts: str = "ts", order: str = "id") -> DataFrame:
    """(key, id, allowed) under windows that begin at a client's first request. An effect names as many windows at most as its
    range has requests within `seconds` of its first one."""
    length = round(seconds * 1e6)

    def step(state, row):
        return anchored_step(state, row[0], limit, length)

    return in_order(requests, key, ts, order, [], "allowed boolean", Automaton(None, step, lambda: AnchorEffect(length))).drop("us")


def token_bucket(requests: DataFrame, config: LimiterConfig | None = None, rate: float | None = None, key: str = "client", ts: str = "ts", order: str = "id", tokens: str = "tokens", with_time: bool = False) -> DataFrame:
    """(key, id, taken, wait_seconds, left): wait_seconds is null where the request exceeds the bucket itself, or nothing refills
    it. with_time adds us, the time in microseconds. Without a config, requests bring refill_per_second and capacity, the same in all rows of a key. Null tokens are none."""
    speed, most = F.col("refill_per_second"), F.col("capacity")
    if config:
        speed, most = F.lit(config.refill_per_second if rate is None else rate), F.lit(config.burst)
    asked = requests.withColumns({"wanted_": F.col(tokens).cast("double"), "rate_": speed.cast("double"), "most_": most.cast("double")})
    found = in_order(asked, key, ts, order, ["wanted_", "rate_", "most_"], "taken boolean, wait_seconds double, left double", Automaton(None, units_step, BucketEffect))
    return found if with_time else found.drop("us")


def provider_acquired(requests: DataFrame, providers: DataFrame, key: str = "provider", ts: str = "ts", order: str = "id", tokens: str = "tokens") -> DataFrame:
    """token_bucket with its times under limits by provider: providers(provider, requests_per_minute, tokens_per_minute, burst). The refill
    follows the tighter of the two rates; a request to an unknown provider is an error."""
    known = providers.select(F.col("provider").alias("provider_"), (F.least("requests_per_minute", "tokens_per_minute") / 60).alias("refill_per_second"), F.col("burst").alias("capacity"))
    unknown = F.raise_error(F.concat(F.lit("unknown provider: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    joined = requests.join(known, F.col(key) == F.col("provider_"), "left")
    return token_bucket(joined.withColumn("capacity", F.when(F.col("provider_").isNull(), unknown).otherwise(F.col("capacity"))), key=key, ts=ts, order=order, tokens=tokens, with_time=True)


def provider_status(acquired: DataFrame, providers: DataFrame) -> DataFrame:
    """(provider, calls, taken, tokens, capacity, share) after the last request of each, full for those without one."""
    last = acquired.groupBy(F.col("key").alias("provider")).agg(F.count("*").alias("calls"), F.count_if("taken").alias("taken"), F.max_by("left", F.struct("us", "id")).alias("tokens"))
    joined = providers.select("provider", F.col("burst").cast("double").alias("capacity")).join(last, "provider", "left")
    left = F.coalesce("tokens", "capacity")
    return joined.select("provider", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("taken", F.lit(0)).alias("taken"), left.alias("tokens"), "capacity", (left / F.col("capacity")).alias("share"))


@lru_cache(maxsize=4096)
def _breaker_config(failures: int, recovery: int, trials: int, successes: int) -> BreakerConfig:
    """recovery in microseconds, as are the times of rows."""
    return BreakerConfig(failures, recovery, trials, successes)


def _breaker_row(b: Breaker | None, row: tuple) -> tuple[Breaker, bool, str]:
    b, admitted = breaker_step(b, row[0], bool(row[1]), _breaker_config(*row[2:]))
    return b, admitted, b.state


def circuit_breaker(calls: DataFrame, config: BreakerConfig | None = None, key: str = "name", ts: str = "ts", order: str = "id", succeeded: str = "succeeded", registry: DataFrame | None = None) -> DataFrame:
    """(key, id, admitted, state): the state after each call. registry(name, failures, recovery_seconds, trials, successes): the
    breakers by name; calls of a name that isn't there go by config. A null outcome is a failure."""
    c = config or BreakerConfig()
    given = {"failures": c.failures, "recovery_seconds": c.recovery_seconds, "trials": c.trials, "successes": c.successes}
    if registry is not None:
        # Registering a name again changes nothing.
        first = registry.dropDuplicates(["name"]).select(F.col("name").alias("name_"), *(F.col(x).alias(f"{x}_") for x in given))
        calls = calls.join(first, F.col(key) == F.col("name_"), "left")
    number = {x: F.coalesce(F.col(f"{x}_"), F.lit(v)) if registry is not None else F.lit(v) for x, v in given.items()}
    number["recovery_seconds"] = F.round(number["recovery_seconds"] * 1e6)
    named = calls.withColumns({"ok_": F.coalesce(F.col(succeeded), F.lit(False)), **{f"{x}_": v.cast("long") for x, v in number.items()}})
    return in_order(named, key, ts, order, ["ok_", *(f"{x}_" for x in given)], "admitted boolean, state string", Automaton(None, _breaker_row, lambda: BreakerEffect(_breaker_row))).drop("us")


def exponential(attempt: Column, c: BackoffConfig) -> Column:
    return F.least(F.lit(c.initial) * F.pow(F.lit(c.base), attempt), F.lit(c.most))


def linear(attempt: Column, c: BackoffConfig) -> Column:
    return F.least(F.lit(c.initial) * (attempt + 1), F.lit(c.most))


def fixed(c: BackoffConfig) -> Column:
    return F.lit(c.initial)


def not_before(failed: Column, delay: Column) -> Column:
    """When a task that failed may be tried again."""
    return F.timestamp_micros(F.unix_micros(failed) + F.round(delay * 1e6).cast("long"))


def jittered(delay: Column, share: float, seed: int) -> Column:
    return delay + F.rand(seed) * delay * share
