import hashlib
import random
import zlib

import numpy as np
import pytest

from commweave.llm import jpeg

ONES = np.ones(64, np.uint8)


def image(rng, width, height, sampling, density, interval=0, most=300):
    g = jpeg.geometry(width, height, tuple(sampling))
    im = jpeg.Image(g, np.zeros((g.blocks, 64), np.int32), [np.arange(1, 65).astype(np.uint8)], interval=interval)
    every = tuple(range(len(sampling)))
    im.coef[:] = rng.integers(-most, most, im.coef.shape) * (rng.random(im.coef.shape) < density)
    for i in every:  # padding blocks have a DC only in scans of all components
        padding = np.setdiff1d(np.arange(g.starts[i], g.starts[i + 1]), g.order((i,)).reshape(-1))
        im.coef[padding, 0 if len(every) == 1 else 1 :] = 0
    return im


SAMPLINGS = [[(1, 1)], [(2, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(3, 1), (2, 2), (1, 1)]]


@pytest.mark.parametrize("sampling", SAMPLINGS)
@pytest.mark.parametrize("density", [0.0, 0.03, 0.3, 1.0])
@pytest.mark.parametrize("most", [2, 300])
def test_scans_accumulate_to_the_coefficients(sampling, density, most):
    rng = np.random.default_rng(5)
    images = [image(rng, *size, sampling, density, interval, most) for size in ((1, 1), (8, 8), (37, 53)) for interval in (0, 1, 4)]
    files = jpeg.encode_many(images)
    for im, file, back in zip(images, files, jpeg.decode_many(files)):
        assert (im.coef == back.coef).all()
        assert jpeg.to_rgb(back).shape == (im.geometry.height, im.geometry.width, 3)
        assert jpeg.encode_many([im]) == [file]


def symbols_of(word, length):
    return list(zip(np.asarray(word).tolist(), np.asarray(length).tolist()))


def by_hand(band, low, high, interval):
    """The words of a band's scan from the format's description, block by block, coefficient by coefficient."""
    code = jpeg.REFINE_CODE if high else jpeg.AC_CODE
    out, run, pending = [], 0, []

    def put(symbol, extra=0, n=0):
        out.append((int(code.code[symbol]) << n | extra, int(code.length[symbol]) + n))

    def ended():
        nonlocal run, pending
        if run:
            n = run.bit_length() - 1
            put(n << 4, run - (1 << n), n)
            out.extend(pending)
        run, pending = 0, []

    for at, block in enumerate(band.tolist()):
        if interval and at % interval == 0:
            ended()
        level = [abs(v) >> low for v in block]
        ends = [k for k, v in enumerate(level) if v and (not high or v == 1)]
        zeros, fixes, last = 0, [], max(ends, default=-1)
        for k, m in enumerate(level):
            if k > last:
                fixes += [(m & 1, 1)] if m else []
                continue
            if m == 0:
                zeros += 1
                if zeros == 16:
                    ended()
                    put(0xF0)
                    out.extend(fixes)
                    zeros, fixes = 0, []
            elif high and m > 1:
                fixes.append((m & 1, 1))
            else:
                ended()
                n = m.bit_length()
                put(zeros << 4 | n, int(block[k] > 0) if high else m if block[k] > 0 else (1 << n) - 1 - m, n)
                out.extend(fixes)
                zeros, fixes = 0, []
        if last < len(level) - 1:
            run += 1
            pending += fixes
    ended()
    return out


@pytest.mark.parametrize("density", [0.02, 0.2, 0.9])
@pytest.mark.parametrize("high", [0, 1])
def test_words_match_the_description(density, high):
    rng = np.random.default_rng(9)
    band = rng.integers(-6, 7, (40, 63)) * (rng.random((40, 63)) < density)
    band[10:16] = 0
    fresh = np.arange(40) % 8 == 0
    word, length, _ = (jpeg._ac_refine_words if high else jpeg._ac_first_words)(band, 0 if high else 1, fresh)
    assert symbols_of(word, length) == by_hand(band, 0 if high else 1, high, 8)


def test_end_of_band_runs_over_many_blocks():
    g = jpeg.geometry(8 * 300, 8 * 120, ((1, 1),))
    im = jpeg.Image(g, np.zeros((g.blocks, 64), np.int32), [ONES])
    im.coef[30_007, 9] = -5
    assert (jpeg.decode(jpeg.encode_many([im])[0]).coef == im.coef).all()


def test_inverse_transform_matches_its_definition():
    rng = np.random.default_rng(6)
    coef = np.zeros((8, 8))
    coef.flat[jpeg.ZIGZAG[:10]] = rng.integers(-40, 40, 10)
    coef[0, 0] = 80
    x = np.arange(8)
    basis = np.cos((2 * x[:, None] + 1) * x[None] * np.pi / 16) * np.where(x == 0, np.sqrt(1 / 8), 0.5)
    want = np.clip(basis @ coef @ basis.T + 128, 0, 255)
    im = jpeg.Image(jpeg.geometry(8, 8, ((1, 1),)), coef.flat[jpeg.ZIGZAG].astype(np.int32).reshape(1, 64), [ONES])
    assert np.abs(jpeg.to_rgb(im)[:, :, 0] - want).max() <= 1


def test_chroma_is_repeated_to_full_resolution():
    g = jpeg.geometry(16, 16, jpeg.SAMPLING)
    im = jpeg.Image(g, np.zeros((6, 64), np.int32), [ONES])
    im.coef[5, 0] = 8 * 100
    back = jpeg.decode(jpeg.encode_many([im])[0])
    rgb = jpeg.to_rgb(jpeg.Image(g, back.coef, [ONES] * 3))
    assert (rgb == rgb[0, 0]).all() and rgb[0, 0, 0] == 255 and abs(int(rgb[0, 0, 1]) - (128 - 71)) <= 1


def test_a_scan_written_by_hand():
    """DC differences 5, 9, 9 in three restart intervals, with codes of two bits for sizes 3 and 4."""
    out = b"\xff\xd8" + jpeg._segment(0xDB, bytes([0]) + bytes([1] * 64)) + jpeg._segment(0xC2, bytes([8, 0, 8, 0, 24, 1, 1, 0x11, 0])) + jpeg._segment(0xDD, bytes([0, 1]))
    out += jpeg._segment(0xC4, bytes([0, 0, 2] + [0] * 14 + [3, 4])) + jpeg._segment(0xDA, bytes([1, 1, 0, 0, 0, 0]))
    bits = ["00" + "101", "01" + "1001", "01" + "1001"]
    out += b"".join(bytes([int(b.ljust(8, "1"), 2)]) + (bytes([0xFF, 0xD0 + i]) if i < 2 else b"") for i, b in enumerate(bits)) + b"\xff\xd9"
    assert jpeg.decode(out).coef[:, 0].tolist() == [5, 9, 9]


def test_malformed_files_are_none_and_harm_no_others():
    r = random.Random(3)
    good = jpeg.store_many([b"The quick brown fox, " * 40, b"abc" * 64])
    wanted = [jpeg.payload_of(x) for x in jpeg.decode_many(good)]
    other = [b"", b"GIF89a", b"\xff\xd8", b"\xff\xd8\xff\xd9", b"\xff\xd8\xff\xc0\x00\x0b\x08\x00\x08\x00\x08\x01\x01\x11\x00", None]
    scan_first = good[0][:2] + jpeg._segment(0xDA, bytes([1, 1, 0, 0, 0, 0])) + good[0][2:]
    frame = good[0].index(b"\xff\xc2")
    no_factor = good[0][: frame + 11] + b"\x00" + good[0][frame + 12 :]
    huge = good[0][: frame + 5] + b"\xff\xdc\xff\xdc" + good[0][frame + 9 :]
    files = [*other, scan_first, no_factor, huge]
    for _ in range(400):
        x = bytearray(r.choice(good))
        for _ in range(r.randint(1, 4)):
            x[r.randrange(len(x))] = r.randrange(256)
        files.append(bytes(x[: r.randrange(len(x))] if r.random() < 0.3 else x))
    back = jpeg.decode_many([good[0], *files, good[1]], most_blocks=10_000)
    assert [jpeg.payload_of(back[0]), jpeg.payload_of(back[-1])] == wanted
    assert all(x is None for x in back[1 : 1 + len(other) + 3])
    for x in back:
        if x is not None:
            assert jpeg.to_rgb(x).shape[2] == 3
    with pytest.raises(ValueError):
        jpeg.decode(b"GIF89a")


def test_payloads_come_back():
    rng = np.random.default_rng(7)
    payloads = [rng.integers(0, 256, n * jpeg.UNIT, dtype=np.uint8).tobytes() for n in (1, 2, 100, 2 * jpeg.MOST_COLUMNS + 3)]
    payloads += [bytes([b]) * 192 for b in (0, 32, 101, 255)]
    files = jpeg.store_many(payloads)
    assert [jpeg.payload_of(x) for x in jpeg.decode_many(files)] == payloads
    assert files[1] == jpeg.store(payloads[1])


def test_prose_reaches_runs_ends_and_refinements():
    file = jpeg.store((b"It is, on the whole, a text of  some words and spaces.  " * 9).ljust(768))
    (im,) = jpeg.decode_many([file])
    _, scans = jpeg._parse(0, file, 1 << 20)
    assert {(s.start, s.end, s.high, s.low) for s in scans} == {(0, 0, 0, 1), (1, 5, 0, 1), (6, 63, 0, 1), (1, 9, 0, 0), (10, 63, 0, 0), (0, 0, 1, 0), (1, 63, 1, 0)}
    assert im.geometry.sampling == jpeg.SAMPLING and (im.coef < 0).any() and (im.coef == 0).sum() > 100
    rgb = jpeg.to_rgb(im)
    assert ((rgb == 0) | (rgb == 255)).mean() < 0.05


def test_text_features(docs_of):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "abc"), (4, "abc"), (5, "é" * 96), (None, "x" * 300_000), (6, "y z" * 900_000)]
    got = jpeg.text_features(docs_of(rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for d, t in rows:
        body = (t or "").encode()
        payload = body.ljust(max(192, -(-len(body) // 192) * 192))
        r = by[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["media_sha256"] == hashlib.sha256(jpeg.store(payload)).hexdigest()
    assert by[1][1:] == by[4][1:] and by[2][1:] == by[3][1:]
    assert jpeg.text_features(docs_of([])).count() == 0


def test_decode_media_column(spark):
    good = jpeg.store(b"a" * 192)
    df = spark.createDataFrame([(1, good, "h"), (2, b"junk", "h"), (3, None, "h")], "id long, media binary, height string")
    got = {r["id"]: r for r in jpeg.decode_media(df, "media").collect()}
    assert (got[1]["height"], got[1]["width"], len(got[1]["rgb"])) == (16, 16, 768)
    assert got[2]["rgb"] is None and got[3]["height"] is None
    assert jpeg.decode_media(df.limit(0), "media").count() == 0
