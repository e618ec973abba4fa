"""Best items by content and by mixes: users in blocks meet classes of equal items, pairs are scored in memory, only the best of a user leave."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.checkpoint import cut
from tessera.operators import linalg
from tessera.operators.recommend import normalise_rows

#: Users and classes of equal items that meet in a tile, on average.
USERS, ITEMS = 2048, 2048
#: Marked pairs (seen, or with another score) of a block of users, on average.
MARKS = 500_000
#: Items that one class may hold, on average, where all items are equal.
MEMBERS = 4_000_000
#: Tiles of a block of users whose results are merged.
MERGED = 16
#: Ratings times terms that are added at once.
CELLS = 4_000_000
#: Classes whose best one stands for them in the search for a user's least candidate.
GROUP = 16
#: More than the least step of a score of 6 places.
STEP = 1.01e-6


def _blocks_of(n: int, size: int) -> int:
    return max(1, math.ceil(n / size))


def _block(key: str, blocks: int):
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _packed(at: np.ndarray, term: np.ndarray, w: np.ndarray) -> list[bytes]:
    return [at.astype("<i4").tobytes(), term.astype("<i4").tobytes(), w.astype("<f8").tobytes()]


def _users(users: DataFrame, r: DataFrame, blocks: int) -> DataFrame:
    """One row a block of users: its number, the users in their order and their ratings (u, i, r) as packed numbers."""
    kinds = {"u": users.schema["u"].dataType.simpleString(), "i": r.schema["i"].dataType.simpleString()}

    def pack(users: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(users):
            return pd.DataFrame({c: [] for c in ("ub", "uids", "ru", "ri", "rr")})
        found = np.sort(users["u"].to_numpy())
        r = r.sort_values("u")
        at, mine = _places(found, r["u"].to_numpy())
        return pd.DataFrame([[users["ub"].iloc[0], list(found), at[mine].astype("<i4").tobytes(), list(r["i"].to_numpy()[mine]), r["r"].to_numpy("<f8")[mine].tobytes()]], columns=["ub", "uids", "ru", "ri", "rr"])

    dealt = [x.withColumn("ub", _block("u", blocks)).groupBy("ub") for x in (users, r.select("u", "i", F.col("r").cast("double").alias("r")))]
    return cut(dealt[0].cogroup(dealt[1]).applyInPandas(pack, f"ub int, uids array<{kinds['u']}>, ru binary, ri array<{kinds['i']}>, rr binary"), "blocks")


def _classes(entries: DataFrame, others: DataFrame | None, size: int) -> DataFrame:
    """One row a block of classes: items (i, term, w) of equal entries are one class; all items of a block in their order, the class of each, entries a class.

    `others` (i) without entries are items too.
    """
    kind = entries.schema["i"].dataType.simpleString()
    vector = F.sort_array(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "w"))))
    rows = entries if others is None else entries.unionByName(others.select("i").distinct().join(entries.select("i").distinct(), "i", "left_anti").select("i", F.lit(None).cast("int").alias("term"), F.lit(None).cast("double").alias("w")))
    vectors = cut(rows.groupBy("i").agg(vector.alias("v")), "item-vectors")
    parts = _blocks_of(vectors.count(), MEMBERS)
    held = cut(vectors.groupBy("v", _block("i", parts).alias("part")).agg(F.collect_list("i").alias("members")), "classes")
    blocks = _blocks_of(held.count(), size)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        members = pdf["members"].map(list).tolist()
        ids, of = np.array([i for m in members for i in m], dtype=None if kind != "string" else object), np.repeat(np.arange(len(members)), [len(m) for m in members])
        order = np.argsort(ids, kind="stable")
        entries = [(c, e["term"], e["w"]) for c, v in enumerate(pdf["v"]) for e in v]
        at, term, w = np.array(entries, float).reshape(-1, 3).T
        return pd.DataFrame([[pdf["ib"].iloc[0], list(ids[order]), of[order].astype("<i4").tobytes(), len(members), *_packed(at, term, w)]], columns=["ib", "iids", "icls", "classes", "iat", "iterm", "iw"])

    dealt = held.withColumn("ib", F.pmod(F.xxhash64("v", "part"), F.lit(blocks)).cast("int")).select("ib", "v", "members")
    return cut(dealt.groupBy("ib").applyInPandas(pack, f"ib int, iids array<{kind}>, icls binary, classes int, iat binary, iterm binary, iw binary"), "class-blocks")


class Tiles:
    """Users and items in blocks; `users` (u) get profiles of their ratings (u, i, r) over the item vectors (item, term, w)."""

    def __init__(self, t: DataFrame, r: DataFrame, users: DataFrame, more_items: DataFrame | None = None, marks: int = 0):
        names = sorted(x[0] for x in t.select("term").distinct().collect())  # at most the terms of the vocabulary
        users = cut(users.select("u").distinct(), "tile-users")
        self.width = len(names)
        self.nu = max(_blocks_of(users.count(), USERS), _blocks_of(marks, MARKS))
        self.kinds = {"u": users.schema["u"].dataType.simpleString(), "i": t.schema["item"].dataType.simpleString()}
        self.items = _classes(linalg.numbered(t.withColumnRenamed("item", "i"), "term", names), more_items, ITEMS)
        self.ni = self.items.count()
        self.users = _users(users, r, self.nu)
        self.users = cut(self._profiles(), "profiles")

    def pairs(self, users: DataFrame | None = None) -> DataFrame:
        """All tiles, one row each; all of a block of users in one task, and no pair is shuffled."""
        dealt = (self.users.drop("ru", "ri", "rr") if users is None else users).repartition(min(self.nu, 2000), "ub")
        return dealt.crossJoin(self.items.coalesce(1).hint("shuffle_replicate_nl"))

    def _run(self, users: DataFrame | None, step, merge, finish, schema: str) -> DataFrame:
        """finish(tile, merge([step(tile) of all tiles of a block of users])) of each block; merge is also used on the way."""
        tiles = self.ni

        def run(frames):
            parts = {}
            for frame in frames:
                for tile in frame.itertuples():
                    count, held = parts.get(tile.ub, (0, []))
                    held.append(step(tile))
                    if len(held) > MERGED:
                        held = [merge(held)]
                    parts[tile.ub] = count + 1, held
                    if count + 1 == tiles:
                        yield finish(tile, merge(parts.pop(tile.ub)[1]))
            if parts:
                raise RuntimeError("a block of users lacks tiles")

        return self.pairs(users).mapInPandas(run, schema)

    def _profiles(self) -> DataFrame:
        """The blocks with each user's sum of (r - 3) times item vectors, with length 1, as sparse entries; a term of a rated item is one of the user."""
        width, names = self.width, self.users.columns

        def step(tile):
            v, of_items = _cells(tile.iat, tile.iterm, tile.iw, (tile.classes, width))
            has = np.zeros(v.shape)
            has[of_items] = 1
            at, found = _places(np.asarray(tile.iids), np.asarray(tile.ri))
            u, c, x = np.frombuffer(tile.ru, "<i4")[found], _of(tile)[at[found]], np.frombuffer(tile.rr)[found] - 3
            p, some = np.zeros((len(tile.uids), width)), np.zeros((len(tile.uids), width), bool)
            for k in range(0, len(u), max(1, CELLS // max(width, 1))):
                few = slice(k, k + max(1, CELLS // max(width, 1)))
                mine, first = np.unique(u[few], return_index=True)  # ratings are in the order of their users
                p[mine] += np.add.reduceat(v[c[few]] * x[few, None], first)
                some[mine] |= np.add.reduceat(has[c[few]], first) > 0
            return p, some

        def merge(parts):
            return sum(x[0] for x in parts), np.any([x[1] for x in parts], axis=0)

        def finish(tile, part):
            p, has = part
            norm = np.sqrt((p * p).sum(axis=1))
            u, term = np.nonzero(has)
            cells = _packed(u, term, (p / np.where(norm > 0, norm, 1.0)[:, None])[u, term])
            return pd.DataFrame([[*(getattr(tile, c) for c in names), *cells]], columns=[*names, "uat", "uterm", "uw"])

        return self._run(self.users, step, merge, finish, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.users.schema) + ", uat binary, uterm binary, uw binary")

    def spans(self) -> DataFrame:
        """(ub, lo, hi): least and largest score of each user of a block as packed numbers, infinite without any."""
        width = self.width

        def step(tile):
            scores, shared = _scored(tile, width)
            if shared.all():
                return scores.min(axis=1, initial=np.inf), scores.max(axis=1, initial=-np.inf)
            return np.where(shared, scores, np.inf).min(axis=1, initial=np.inf), np.where(shared, scores, -np.inf).max(axis=1, initial=-np.inf)

        def merge(parts):
            return np.min([p[0] for p in parts], axis=0), np.max([p[1] for p in parts], axis=0)

        def finish(tile, part):
            return pd.DataFrame([[tile.ub, *(x.tobytes() for x in part)]], columns=["ub", "lo", "hi"])

        return self._run(None, step, merge, finish, "ub int, lo binary, hi binary")

    def best(self, k: int = 10) -> DataFrame:
        """(u, i, score to 6 places): the k best of each user, ties by item."""
        width = self.width

        def step(tile):
            scores, shared = _scored(tile, width)
            members, slack = _Members(tile), np.full(len(scores), STEP)
            u, c = _candidates(scores, shared, slack, k)
            need = _needed(u, scores[u, c], members.size[c], slack, k)
            u, at = members.first(u[need], c[need], np.full(need.sum(), k))
            whole = _whole(scores[u, _of(tile)[at]])
            best, _ = _first(u, whole, at, k)
            return u[best], np.asarray(tile.iids)[at[best]], whole[best]

        def merge(parts):
            u, ids, whole = (np.concatenate(x) for x in zip(*parts, strict=True))
            best, _ = _first(u, whole, _order(ids), k)
            return u[best], ids[best], whole[best]

        def finish(tile, part):
            u, ids, whole = part
            return pd.DataFrame({"u": np.asarray(tile.uids)[u], "i": ids, "score": whole / 1e6})

        return self._run(None, step, merge, finish, f"u {self.kinds['u']}, i {self.kinds['i']}, score double")

    def _marked(self, cf: DataFrame, seen: DataFrame | None, wanted: DataFrame | None) -> DataFrame:
        """Blocks of users with spans and their marked pairs: place of the user, item, score scaled to 0..1 or NaN, whether seen (None: rated); and wanted pairs."""
        kinds = self.kinds
        a, no = F.lit(None).cast("double").alias("a"), F.lit(False)
        rows, rated = normalise_rows(cf).select("u", "i", F.col("score").alias("a"), no.alias("seen"), no.alias("wanted")), seen is None
        if seen is not None:
            rows = rows.unionByName(seen.select("u", "i", a, F.lit(True).alias("seen"), no.alias("wanted")))
        if wanted is not None:
            rows = rows.unionByName(wanted.select("u", "i", a, no.alias("seen"), F.lit(True).alias("wanted")))
        blocks = self.users.join(cut(self.spans(), "spans"), "ub")

        def pack(blocks: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
            if not len(blocks):
                return blocks.drop(columns=["ru", "ri", "rr"]).assign(mu=[], mi=[], ma=[], ms=[], wu=[], wi=[])
            users = np.asarray(blocks["uids"].iloc[0])
            at, found = _places(users, marks["u"].to_numpy())
            marks, at = marks[found], at[found]
            goal = marks["wanted"].to_numpy(bool)
            wu, wi, marks, at = at[goal], marks["i"].to_numpy()[goal], marks[~goal], at[~goal]
            u, i, a, old = at, marks["i"].to_numpy(), marks["a"].to_numpy(float), marks["seen"].to_numpy(bool)
            if rated:
                mine = np.frombuffer(blocks["ru"].iloc[0], "<i4")
                u, i = np.concatenate([u, mine]), np.concatenate([i, np.asarray(blocks["ri"].iloc[0], dtype=i.dtype)])
                a, old = np.concatenate([a, np.full(len(mine), np.nan)]), np.concatenate([old, np.ones(len(mine), bool)])
            codes, items = pd.factorize(i)
            pairs, back = np.unique(u.astype(np.int64) * max(len(items), 1) + codes, return_inverse=True)
            score, seen_ = np.full(len(pairs), np.nan), np.zeros(len(pairs), bool)
            np.fmax.at(score, back, a)
            np.logical_or.at(seen_, back, old)
            mu, mi = pairs // max(len(items), 1), items[pairs % max(len(items), 1)]
            return blocks.drop(columns=["ru", "ri", "rr"]).assign(mu=[mu.astype("<i4").tobytes()], mi=[list(mi)], ma=[score.tobytes()], ms=[seen_.tobytes()], wu=[wu.astype("<i4").tobytes()], wi=[list(wi)])

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema if f.name not in ("ru", "ri", "rr"))
        dealt = rows.withColumn("ub", _block("u", self.nu))
        return cut(blocks.groupBy("ub").cogroup(dealt.groupBy("ub")).applyInPandas(pack, f"{fields}, mu binary, mi array<{kinds['i']}>, ma binary, ms binary, wu binary, wi array<{kinds['i']}>"), "marked")

    def best_mixes(self, cf: DataFrame, seen: DataFrame | None, mixes: dict[str, float | None], k: int = 10, wanted: DataFrame | None = None) -> DataFrame:
        """(method, u, i, score to 6 places): as best(), among unseen pairs, of alpha cf + (1 - alpha) content, both scaled to 0..1 a user.

        A mix of None is the content score itself.  cf (u, i, score) must hold all scores of its users; seen of None: the ratings.
        With wanted (u, i): (method, u, place) of those among the best.

        Pairs without a score in cf rank by content alone in each mix, so all mixes share their candidates: the k best
        by content, with all that a mix's rounding may make equal to them, and, for an alpha of 1, the first items.
        """
        width, kinds, goals = self.width, self.kinds, wanted is not None
        tied = any(a is not None and a >= 1 for a in mixes.values())
        slack = max((STEP / (1 - a) for a in mixes.values() if a is not None and a < 1), default=0.0)

        def chosen(u, s, shared, a, given, lo, span, order):
            content = np.where(shared, (s - lo[u]) / span[u], 0.0)
            for name, alpha in mixes.items():
                fits = np.flatnonzero(shared if alpha is None else shared | given)
                whole = _whole((s if alpha is None else alpha * a + (1 - alpha) * content)[fits])
                best, place = _first(u[fits], whole, order[fits], k)
                yield name, fits[best], whole[best], place

        def limits(tile):
            lo, hi = np.frombuffer(tile.lo), np.frombuffer(tile.hi)
            some = hi >= lo
            lo, hi = np.where(some, lo, 0.0), np.where(some, hi, 0.0)
            return lo, np.maximum(hi - lo, 1e-8)

        def step(tile):
            scores, shared = _scored(tile, width)
            members, of, (lo, span) = _Members(tile), _of(tile), limits(tile)
            ids = np.asarray(tile.iids)
            n, width_c = len(ids), scores.shape[1]
            at, found = _places(ids, np.asarray(tile.mi))
            mu, at, a, old = (x[found] for x in (np.frombuffer(tile.mu, "<i4").astype(np.int64), at, np.frombuffer(tile.ma), np.frombuffer(tile.ms, bool)))
            marks = mu * n + at
            pairs, count = np.unique(mu * width_c + of[at], return_counts=True)
            usable = shared.copy()
            full = pairs[count == members.size[pairs % width_c]]
            usable[full // width_c, full % width_c] = False  # nothing unmarked is left of the class
            less = np.maximum(slack * span, STEP)
            u, c = _candidates(scores, usable, less, k)
            where = np.searchsorted(pairs, u * width_c + c)
            held = np.zeros(len(u), np.int64)
            inside = np.flatnonzero(where < len(pairs))
            inside = inside[pairs[where[inside]] == (u * width_c + c)[inside]]
            held[inside] = count[where[inside]]
            need = _needed(u, scores[u, c], members.size[c] - held, less, k)
            u, p = members.first(u[need], c[need], (k + held)[need])
            fresh = u * n + p
            if tied:
                fresh = np.concatenate([fresh, _lowest(shared, of, marks, n, k)])
            fresh = np.setdiff1d(fresh, marks)
            scored = ~old & ~np.isnan(a)
            u, p = np.concatenate([fresh // n, mu[scored]]), np.concatenate([fresh % n, at[scored]])
            a, given = np.concatenate([np.zeros(len(fresh)), a[scored]]), np.repeat([False, True], [len(fresh), scored.sum()])
            s, both = scores[u, of[p]], shared[u, of[p]]
            return u, ids[p], s, both, a, given, less

        def merge(parts):
            u, ids, s, both, a, given = (np.concatenate(x) for x in list(zip(*parts, strict=True))[:6])
            less, free = parts[0][6], np.flatnonzero(~given)
            need = _needed(u[free], s[free], np.ones(len(free), np.int64), less, k)
            if tied:
                need[_first(u[free], np.zeros(len(free), np.int64), _order(ids[free]), k)[0]] = True
            keep = np.concatenate([free[need], np.flatnonzero(given)])
            return u[keep], ids[keep], s[keep], both[keep], a[keep], given[keep], less

        def finish(tile, part):
            u, ids, s, both, a, given, _ = part
            users, out = np.asarray(tile.uids), []
            goal = pd.MultiIndex.from_arrays([np.frombuffer(tile.wu, "<i4"), np.asarray(tile.wi)])
            for name, rows, whole, place in chosen(u, s, both, a, given, *limits(tile), _order(ids)):
                if not goals:
                    out.append(pd.DataFrame({"u": users[u[rows]], "i": ids[rows], "score": whole / 1e6}).assign(method=name))
                else:
                    hit = pd.MultiIndex.from_arrays([u[rows], ids[rows]]).isin(goal) if len(goal) else np.zeros(len(rows), bool)
                    out.append(pd.DataFrame({"u": users[u[rows[hit]]], "place": place[hit] + 1}).assign(method=name))
            return pd.concat(out)[["method", "u", "place"] if goals else ["method", "u", "i", "score"]]

        found = f"i {kinds['i']}, score double" if wanted is None else "place int"
        return self._run(self._marked(cf, seen, wanted), step, merge, finish, f"method string, u {kinds['u']}, {found}")


class _Members:
    """Items of each class of a tile."""

    def __init__(self, tile):
        of = _of(tile)
        self.order = np.argsort(of, kind="stable")
        self.size = np.bincount(of, minlength=tile.classes)
        self.start = np.cumsum(self.size) - self.size

    def first(self, u: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(u, place of the item) of the first n items of each class."""
        n = np.minimum(n, self.size[c])
        row = np.repeat(np.arange(len(n)), n)
        return u[row], self.order[self.start[c][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)]


def _of(tile) -> np.ndarray:
    return np.frombuffer(tile.icls, "<i4")


def _places(ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the ordered ids, whether they are there)."""
    if not len(ids) or not len(wanted):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
    return at, ids[at] == wanted


def _order(ids: np.ndarray) -> np.ndarray:
    return pd.factorize(ids, sort=True)[0]


def _whole(scores: np.ndarray) -> np.ndarray:
    return np.rint(scores * 1e6).astype(np.int64)


def _cells(at: bytes, term: bytes, w: bytes, shape: tuple[int, int]) -> tuple[np.ndarray, tuple]:
    place = np.frombuffer(at, "<i4"), np.frombuffer(term, "<i4")
    out = np.zeros(shape)
    out[place] = np.frombuffer(w, "<f8")
    return out, place


def _scored(tile, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, whether the pair shares a term): users by classes."""
    p, of_users = _cells(tile.uat, tile.uterm, tile.uw, (len(tile.uids), width))
    v, of_items = _cells(tile.iat, tile.iterm, tile.iw, (tile.classes, width))
    scores = p @ v.T
    shared = scores != 0
    if not shared.all():  # a score of 0 may be one of shared terms
        ones = np.zeros(p.shape, np.float32), np.zeros(v.shape, np.float32)
        ones[0][of_users], ones[1][of_items] = 1, 1
        shared = ones[0] @ ones[1].T > 0
    return scores, shared


def _candidates(scores: np.ndarray, usable: np.ndarray, slack: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(user, class) of the k best usable scores of each user and all less by no more than the slack, with some more."""
    s = scores if usable.all() else np.where(usable, scores, -np.inf)
    n = s.shape[1]
    groups = n // GROUP
    if groups >= 2 * k:  # the k-th best of the groups' best is no more than the k-th best of all
        s_best, n_best = s[:, : groups * GROUP].reshape(len(s), GROUP, groups).max(axis=1), groups
    else:
        s_best, n_best = s, n
    least = np.partition(s_best, n_best - k, axis=1)[:, n_best - k] if n_best > k else np.full(len(s), -np.inf)
    return np.nonzero(usable & (s >= (least - slack)[:, None]))


def _needed(u: np.ndarray, s: np.ndarray, n: np.ndarray, slack: np.ndarray, k: int) -> np.ndarray:
    """Which of the classes, of n items each, hold the k best items of each user or score less by no more than the slack."""
    at = np.lexsort((-s, u))
    ahead = np.cumsum(n[at]) - n[at]
    first = np.searchsorted(u[at], u[at])
    inside = at[ahead - ahead[first] < k] if len(at) else at
    least = np.full(len(slack), np.inf)
    np.minimum.at(least, u[inside], s[inside])
    return s >= (least - slack)[u]


def _lowest(shared: np.ndarray, of: np.ndarray, marks: np.ndarray, n: int, k: int) -> np.ndarray:
    """user * n + place of each user's first k unmarked items that share a term."""
    width = 2 * k
    while True:
        width = min(width, n)
        fits = shared[:, of[:width]]
        near = marks[marks % n < width]
        fits[near // n, near % n] = False
        if width == n or (fits.sum(axis=1) >= k).all():
            u, p = np.nonzero(fits & (np.cumsum(fits, axis=1) <= k))
            return u * n + p
        width *= 4


def _first(u: np.ndarray, whole: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, places from 0) of the k largest of each user, ties by order."""
    at = np.lexsort((order, -whole, u))
    rows = np.arange(len(at))
    new = np.ones(len(at), bool)
    new[1:] = u[at][1:] != u[at][:-1]
    place = rows - np.maximum.accumulate(np.where(new, rows, 0)) if len(at) else rows
    return at[place < k], place[place < k]
