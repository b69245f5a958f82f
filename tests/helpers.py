import random


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def minute_series(meter, n, start=1301702400, usage=lambda m: float(m % 7), step=60):
    return [(meter, start + step * m, usage(m)) for m in range(n)]


def gap_counts(readings, interval=60):
    """Gap statistics by definition, one meter after the other."""
    out = {}
    for meter in {r[0] for r in readings}:
        times = sorted(t for b, t, _ in readings if b == meter and t is not None)
        regular = sum(1 for a, b in zip(times, times[1:]) if b - a == interval)
        out[meter] = (len(times), regular, len(times) - regular)
    return out


def raster_readings(seed, n=3000):
    """Long series on one raster each, with holes, copies and edges of blocks and slots."""
    rng = random.Random(seed)
    out = []
    for meter, start in enumerate([-90_000, -3_600, 0, 17, 86_400 - 600, 1301702400 + 3_559]):
        t = start
        for _ in range(n):
            out.append((meter, t, rng.random()))
            t += 60 * rng.choice([1] * 30 + [0, 2, 59, 60, 61])
    rng.shuffle(out)
    return out


def random_readings(seed, meters=6, n=300):
    rng = random.Random(seed)
    out = []
    for meter in range(-2, meters - 2):
        t = rng.randrange(-200_000, 200_000)
        for _ in range(n):
            out.append((meter, t, rng.random()))
            t += rng.choice([0, 60, 60, 60, 60, 59, 120, 86_400, 90_000])
    rng.shuffle(out)
    return out
