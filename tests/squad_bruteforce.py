"""Plain-Python brute force of the two line-up rule sets, for tests only.

Every swap re-solves the whole eleven, exactly as the rules read; the Spark
operator must agree with it on every squad.
"""

from __future__ import annotations

from leagueflow.operators.squads import CLI_FORMATIONS, MAX_PER_TEAM, PRESETS, SERVICE_FALLBACK


def _order(members, score):
    # best first; ties keep squad order
    return sorted(members, key=lambda m: (-score(m), m["slot"]))


def eleven_capped(members, score):
    """members: dicts with slot, id, role, team. Returns total (cents)."""
    best = None
    for quota in CLI_FORMATIONS:
        used: dict = {}
        total, ok = 0, True
        for role, need in zip((1, 2, 3, 4), quota):
            got = 0
            for m in _order([m for m in members if m["role"] == role], score):
                if got >= need:
                    break
                if used.get(m["team"], 0) >= MAX_PER_TEAM:
                    continue
                used[m["team"]] = used.get(m["team"], 0) + 1
                total += score(m)
                got += 1
            if got < need:
                ok = False
                break
        if ok and total > -100 and (best is None or total > best):
            best = total
    return max(0, best if best is not None else 0)


def eleven_uncapped(members, score):
    by = {r: _order([m for m in members if m["role"] == r], score) for r in (1, 2, 3, 4)}
    gk = sum(score(m) for m in by[1][:1])
    best = None
    for f in PRESETS["service"].formations:
        _, d, mi, fw = f
        if d > len(by[2]) or mi > len(by[3]) or fw > len(by[4]):
            continue
        t = gk + sum(score(m) for m in by[2][:d]) + sum(score(m) for m in by[3][:mi]) + sum(score(m) for m in by[4][:fw])
        if t > -100 and (best is None or t > best):
            best = t
    if best is not None:
        return best
    _, d, mi, fw = SERVICE_FALLBACK
    return gk + sum(score(m) for m in by[2][:d]) + sum(score(m) for m in by[3][:mi]) + sum(score(m) for m in by[4][:fw])


def swaps(members, pool, scores, bank, preset, top_n):
    """All feasible swaps ranked like the operator; returns [(out_id, in_id, delta, new)]."""
    capped = preset == "cli"
    solve = eleven_capped if capped else eleven_uncapped

    def score(m):
        return scores.get(m["id"], 0)

    cur = solve(members, score)
    owned = {m["id"] for m in members}
    counts: dict = {}
    for m in members:
        if m["team"] is not None:
            counts[m["team"]] = counts.get(m["team"], 0) + 1
    out = []
    for o in sorted(members, key=lambda m: m["slot"]):
        if capped and o["role"] not in (1, 2, 3, 4):
            continue
        for c in sorted(pool, key=lambda p: p["id"]):
            if c["id"] in owned or c["role"] != o["role"]:
                continue
            if capped and c["id"] not in scores:
                continue
            if c["cost"] > o["cost"] + bank:
                continue
            if capped:
                n = counts.get(c["team"], 0) - (1 if c["team"] == o["team"] else 0)
                if n >= MAX_PER_TEAM:
                    continue
            elif c["team"] is not None and c["team"] != o["team"] and counts.get(c["team"], 0) >= MAX_PER_TEAM:
                continue
            new_members = [dict(c, slot=o["slot"]) if m is o else m for m in members]
            new = solve(new_members, score)
            out.append((o["id"], c["id"], new - cur, new))
    out.sort(key=lambda r: -r[2])  # stable: seller slot, then buyer id
    return cur, out[:top_n]
