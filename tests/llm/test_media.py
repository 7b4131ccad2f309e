import random

import numpy as np

from quarry.llm import jpeg, media


class Scalar:
    """A plain decoder, one bit after the other, to hold the lockstep one against."""

    def __init__(self, data):
        self.h = jpeg.parse(data)
        s = self.h.shape
        self.c = [[[0] * 64 for _ in range(n)] for n in s.blocks]
        hm, vm = max(h for h, _ in s.sampling), max(v for _, v in s.sampling)
        at = [jpeg.places(s, c).tolist() for c in range(len(s.blocks))]
        # blocks of a component's own scans: those with pixels
        own = [[at[c][y][x] for y in range(len(at[c])) for x in range(len(at[c][0])) if 8 * y * vm < s.size[0] * v and 8 * x * hm < s.size[1] * h] for c, (h, v) in enumerate(s.sampling)]
        for comps, lo, hi, ah, al, interval, tables, a, z in self.h.scans:
            parts, cur, i = [], bytearray(), a
            while i < z:
                if data[i] == 255 and data[i + 1] == 0:
                    cur.append(255)
                    i += 2
                elif data[i] == 255:
                    parts.append(cur)
                    cur = bytearray()
                    i += 2
                else:
                    cur.append(data[i])
                    i += 1
            parts.append(cur)
            codes = [{v[::-1]: k for k, v in jpeg.canonical(list(t[0]), list(t[1])).items()} if t else None for t in tables]
            if len(comps) > 1:
                mcus = [[(c, at[c][my * v + j][mx * h + i]) for c, (h, v) in enumerate(s.sampling) if c in comps for j in range(v) for i in range(h)] for my in range(s.down) for mx in range(s.across)]
            else:
                mcus = [[(comps[0], b)] for b in own[comps[0]]]
            total = len(mcus)
            interval = interval or total
            for p, part in enumerate(parts):
                self.bits = "".join(f"{x:08b}" for x in part)
                self.at = 0
                pred, eob = [0, 0, 0], 0
                for u in range(p * interval, min(total, (p + 1) * interval)):
                    if lo == 0:
                        for c, b in mcus[u]:
                            blk = self.c[c][b]
                            if ah:
                                blk[0] |= self.take(1) << al
                            else:
                                n = self.symbol(codes[comps.index(c)])
                                pred[c] += self.extend(n)
                                blk[0] = pred[c] << al
                    elif ah:
                        eob = self.refine(self.c[comps[0]][mcus[u][0][1]], codes[0], lo, hi, al, eob)
                    else:
                        eob = self.first(self.c[comps[0]][mcus[u][0][1]], codes[0], lo, hi, al, eob)

    def take(self, n):
        v = int(self.bits[self.at : self.at + n] or "0", 2) if n else 0
        self.at += n
        return v

    def symbol(self, codes):
        n, v = 0, 0
        while (n, v) not in codes:
            v = 2 * v + self.take(1)
            n += 1
        return codes[n, v]

    def extend(self, n):
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    def first(self, b, codes, lo, hi, al, eob):
        if eob:
            return eob - 1
        k = lo
        while k <= hi:
            r, s = divmod(self.symbol(codes), 16)
            if s:
                k += r
                b[k] = self.extend(s) * (1 << al)
            elif r < 15:
                return (1 << r) + self.take(r) - 1
            else:
                k += 15
            k += 1
        return 0

    def refine(self, b, codes, lo, hi, al, eob):
        k = lo
        fix = lambda k: b[k] + (self.take(1) << al) * (1 if b[k] > 0 else -1)
        if not eob:
            while k <= hi:
                r, s = divmod(self.symbol(codes), 16)
                v = 0
                if s:
                    v = 1 if self.take(1) else -1
                elif r < 15:
                    eob = (1 << r) + self.take(r)
                    break
                while k <= hi:
                    if b[k]:
                        b[k] = fix(k)
                    elif r == 0:
                        b[k] = v << al if v > 0 else -(-v << al)
                        k += 1
                        break
                    else:
                        r -= 1
                    k += 1
        if eob:
            while k <= hi:
                if b[k]:
                    b[k] = fix(k)
                k += 1
            eob -= 1
        return eob


def payloads():
    r = random.Random(1)
    out = [b"", b"a", bytes(range(256)) * 9, b"\x80" * 5000, b"\xff" * 576, b"\x00" * 577, bytes(r.choice([0, 127, 128, 129, 255]) for _ in range(3000))]
    return [media.payload_of(p) for p in [*out, *(bytes(r.choice([128] * k + [r.randrange(256)]) for _ in range(r.randrange(4000))) for k in (0, 1, 5, 40, 200))]]


def test_lossless_and_equal_to_a_plain_decoder():
    ps = payloads()
    files = media.to_files(ps)
    back, tensors = media.from_files(files)
    assert back == ps
    for f, t in zip(files, tensors):
        s = Scalar(f)
        heads, coefs, bases = jpeg.decode([f])
        for c in range(3):
            assert np.array_equal(np.asarray(s.c[c]), coefs[c])
        assert np.array_equal(media.from_files([f])[1][0], t)  # whatever the batch
        # the transform against its textbook form
        y = coefs[0][0].astype(float)
        block = np.zeros(64)
        block[jpeg.ZIGZAG] = y
        b = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
        want = np.clip(b.T @ block.reshape(8, 8) @ b + 128, 0, 255)
        assert np.abs(jpeg.samples(coefs[0][:1], heads[0].quant[0])[0] - want).max() <= 0.75


def test_wide_image_has_rows():
    p = media.payload_of(bytes(random.Random(3).randrange(256) for _ in range(64 * 6 * 600)))
    (f,) = media.to_files([p])
    assert jpeg.parse(f).shape.down == 3 and media.from_files([f])[0] == [p]


def test_columns_and_edge_cases(spark):
    df = spark.createDataFrame([(1, "abc", "m"), (None, None, "m"), (2, "", "m"), (3, "é" * 40000, "m"), (1, "abc", "m")], "doc_id long, text string, media string")
    rows = media.media_columns(df).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0] == by[1][1] and by[None][0].payload_bytes == by[2][0].payload_bytes == 576 and by[3][0].n_bytes == 80000
    assert by[None][0].media == by[2][0].media
    for r in rows:
        assert len(r.tensor) == r.height * r.width * 3 and r.media_bytes == len(r.media)
    assert media.media_columns(df.limit(0)).count() == 0


SAMPLINGS = [((1, 1),), ((1, 1),) * 3, ((2, 1), (1, 1), (1, 1)), ((1, 2), (1, 1), (1, 1)), ((2, 2), (1, 1), (1, 1)), ((2, 2), (2, 1), (1, 2)), ((4, 1), (1, 1), (2, 1))]


def foreign(seed=4):
    """Files of all samplings and odd sizes, with their coefficients."""
    r = np.random.default_rng(seed)
    out = []
    for sampling in SAMPLINGS:
        shapes = [jpeg.shape_of(int(h), int(w), sampling) for h, w in [(1, 1), (8, 8), (17, 33), (40, 23), (64, 64), *r.integers(1, 70, (3, 2))]]
        coefs = []
        for c in range(len(sampling)):
            n = sum(s.blocks[c] for s in shapes)
            v = np.where(r.random((n, 64)) < 0.1, r.integers(-60, 60, (n, 64)), 0)
            v[:, 0] = r.integers(-400, 400, n)
            coefs.append(v.astype(np.int16))
        at = [0] * len(sampling)
        for f, s in zip(jpeg.encode(shapes, coefs, [b""] * len(shapes)), shapes):
            out.append((f, s, [coefs[c][at[c] : at[c] + s.blocks[c]] for c in range(len(sampling))]))
            at = [a + n for a, n in zip(at, s.blocks)]
    return out


def textbook(s, coefs):
    """Pixels in floating point: inverse transform block by block, the nearest sample of each component, JFIF's conversion."""
    b = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    (height, width), hm, vm = s.size, max(h for h, _ in s.sampling), max(v for _, v in s.sampling)
    planes = []
    for c, (h, v) in enumerate(s.sampling):
        grid = jpeg.places(s, c)
        p = np.zeros((8 * grid.shape[0], 8 * grid.shape[1]))
        for y in range(grid.shape[0]):
            for x in range(grid.shape[1]):
                z = np.zeros(64)
                z[jpeg.ZIGZAG] = coefs[c][grid[y, x]]
                p[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = np.clip(b.T @ z.reshape(8, 8) @ b + 128, 0, 255)
        planes.append(np.array([[p[y * v // vm, x * h // hm] for x in range(width)] for y in range(height)]))
    if len(planes) == 1:
        return np.stack(planes * 3, 2)
    y, u, v = planes[0], planes[1] - 128, planes[2] - 128
    return np.clip(np.stack([y + 1.402 * v, y - 0.344136 * u - 0.714136 * v, y + 1.772 * u], 2), 0, 255)


def test_any_sampling_and_size_against_a_plain_decoder():
    cases = foreign()
    heads, coefs, bases = jpeg.decode([f for f, _, _ in cases])
    tensors = jpeg.pixels(heads, coefs, bases)
    for i, (f, s, want) in enumerate(cases):
        assert heads[i].shape == s and tensors[i].shape == (*s.size, 3)
        plain = Scalar(f)
        for c, (rows, cols) in enumerate(s.own):
            got = coefs[c][bases[c][i] : bases[c][i + 1]]
            assert np.array_equal(got, np.asarray(plain.c[c]))
            assert np.array_equal(got[: rows * cols], want[c][: rows * cols])  # filling blocks have no detail
        alone = jpeg.pixels(*jpeg.decode([f]))[0]
        assert np.array_equal(alone, tensors[i])
        assert np.abs(alone - textbook(s, [plain.c[c] for c in range(len(s.sampling))])).max() <= 3


def without_restarts(f):
    """The same file with no restart interval declared, where no scan has more than one."""
    at = f.index(b"\xff\xdd\x00\x04")
    return f[:at] + f[at + 6 :]


def test_files_of_other_writers():
    s = jpeg.shape_of(10, 20, ((1, 1),))
    c = np.zeros((6, 64), np.int16)
    c[:, 0], c[:, 5] = np.arange(6) * 9, 3
    c = c[: s.blocks[0]]
    small = jpeg.shape_of(9, 15, ((1, 1),))
    (f,) = jpeg.encode([small], [c[: small.blocks[0]]], [b""])
    want = jpeg.pixels(*jpeg.decode([f]))[0]
    assert np.array_equal(jpeg.pixels(*jpeg.decode([without_restarts(f)]))[0], want)
    # 16-bit quantisation tables, filling bytes before a marker
    q = f.index(b"\xff\xdb")
    wide = f[:q] + b"\xff\xff\xdb" + (131).to_bytes(2, "big") + b"\x10" + b"\x00\x01" * 64 + f[q + 69 :]
    assert np.array_equal(jpeg.pixels(*jpeg.decode([wide]))[0], want)
    # red, green and blue by Adobe's marker
    t = jpeg.shape_of(8, 8, ((1, 1),) * 3)
    dc = [np.array([[v] + [0] * 63], np.int16) for v in (400, 0, -400)]
    (g,) = jpeg.encode([t], dc, [b""])
    adobe = g[:2] + b"\xff\xee\x00\x0eAdobe\x00\x64\x00\x00\x00\x00\x00" + g[2:]
    assert jpeg.pixels(*jpeg.decode([adobe]))[0][0, 0].tolist() == [178, 128, 78]


def test_tensors_of_a_column(spark, monkeypatch):
    cases = foreign(9)
    good = cases[11][0]
    bad = [b"", b"\xff\xd8", good[:40], good[: len(good) // 2], b"no picture", good.replace(b"\xff\xc2", b"\xff\xc0")]
    rows = [(i, f, "x") for i, (f, _, _) in enumerate(cases)] + [(1000 + i, f, "x") for i, f in enumerate(bad)] + [(None, good, "x"), (5, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, media binary, error string").repartition(2)
    got = media.tensors(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id != 5 or r.tensor}
    for i, (f, s, _) in enumerate(cases):
        r = by[i]
        assert (r.height, r.width, r.error) == (*s.size, None) and bytes(r.tensor) == jpeg.pixels(*jpeg.decode([f]))[0].tobytes()
    assert all(by[1000 + i].tensor is None and by[1000 + i].error for i in range(len(bad)))
    assert bytes(by[None].tensor) == bytes(by[11].tensor)
    assert [r for r in got if r.doc_id == 5 and r.tensor is None][0].error is None
    assert media.tensors(df.limit(0)).count() == 0
    # images that stand alone in a batch
    import pyarrow as pa

    monkeypatch.setattr(media, "MOST_PIXELS", 500)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(cases)), pa.int64()), pa.array([f for f, _, _ in cases], pa.binary())], names=["doc_id", "media"])
    parts = list(media._tensors(batch))
    assert len(parts) > 10 and [x.as_py() for p in parts for x in p.column(3)] == [bytes(by[i].tensor) for i in range(len(cases))]
