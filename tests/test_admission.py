import random
from datetime import datetime, timedelta

from weftline.operators import admission as A

T0 = datetime(2024, 1, 1)


def test_admission_equals_a_plain_loop(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["a", "b", None]), T0 + timedelta(milliseconds=rnd.randrange(0, 4000) * 10)) for i in range(500)] + [(900, "a", None)]
    df = spark.createDataFrame(rows, "id long, s string, ts timestamp").repartition(3)
    got = {r.id: (r.admitted, r.remaining, r.retry_in_us) for r in A.admitted(df, ["s"], 3, 1.0).collect()}
    want, log = {}, {}
    for i, s, t in sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[0])):
        held = [x for x in log.get(s, []) if x > t - timedelta(seconds=1)]
        if len(held) < 3:
            held.append(t)
            want[i] = (True, 3 - len(held), None)
        else:
            want[i] = (False, 0, (held[0] + timedelta(seconds=1) - t) // timedelta(microseconds=1))
        log[s] = held
    want[900] = (False, 0, None)
    assert got == want and 0 < sum(w[0] for w in want.values()) < 480


def test_in_flight_equals_a_plain_count(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(300):
        a = T0 + timedelta(seconds=rnd.randrange(60))
        rows.append((i, rnd.choice(["a", None]), a, rnd.choice([None, a, a - timedelta(seconds=2), *[a + timedelta(seconds=rnd.randrange(1, 20))] * 9])))
    rows += [(500, "a", None, T0), (501, "only", T0, T0)]
    df = spark.createDataFrame(rows, "id long, s string, started_at timestamp, ended_at timestamp").repartition(3)
    got = {r.id: (r.in_flight, r.over_limit) for r in A.in_flight(df, ["s"], limit=20).collect()}
    want = {500: (None, None)}
    for i, s, a, _ in rows:
        if a:
            n = 1 + sum(1 for j, t, b, e in rows if b and t == s and j != i and (b, j) < (a, i) and (e is None or (e > a and e > b)))
            want[i] = (n, n > 20)
    assert got == want
    assert A.in_flight(df.limit(0), ["s"]).count() == 0
