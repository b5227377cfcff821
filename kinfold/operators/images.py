"""Image stages: tone mapping, background removal, local descriptors.

Decoders, tone mappers, segmenters and extractors plug in as plain functions; each Python worker
makes its own on first use. By default these are OpenCV's tone mapping and rembg's background
removal where they are installed. The built-in ones need numpy only: they read binary PNM files and
serve where no image library or network weights are at hand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.schema import widened

#: Contrast and saturation kept by tone mapping; side of the centre crop; width of a descriptor.
SCALE, SATURATION, CROP, WIDTH = 0.7, 0.7, 640, 128


def decode(content: bytes) -> np.ndarray:
    """An H x W x 3 (or 4) uint8 array from binary PNM, or any format OpenCV reads if it is there."""
    if content[:2] in (b"P5", b"P6", b"P7"):
        return _decode_pnm(content)
    try:
        import cv2
    except ImportError as e:
        raise ValueError("only binary PNM can be read without OpenCV") from e
    image = cv2.imdecode(np.frombuffer(content, np.uint8), cv2.IMREAD_UNCHANGED)
    if image is None:
        raise ValueError("not an image")
    return image[..., None].repeat(3, axis=2) if image.ndim == 2 else image


def _decode_pnm(content: bytes) -> np.ndarray:
    if content[:2] == b"P7":
        head, _, body = content.partition(b"ENDHDR\n")
        fields = dict(line.split(b" ", 1) for line in head.split(b"\n")[1:] if b" " in line)
        h, w, c = (int(fields[k]) for k in (b"HEIGHT", b"WIDTH", b"DEPTH"))
        return np.frombuffer(body, np.uint8, h * w * c).reshape(h, w, c)
    parts = content.split(maxsplit=3)
    w, h = int(parts[1]), int(parts[2])
    depth = 3 if parts[0] == b"P6" else 1
    image = np.frombuffer(content, np.uint8)[-h * w * depth :].reshape(h, w, depth)
    return image if depth == 3 else image.repeat(3, axis=2)


def encode(image: np.ndarray) -> bytes:
    """Binary PNM with as many channels as the image has; nothing is lost."""
    h, w, c = image.shape
    if c == 3:
        return b"P6\n%d %d\n255\n" % (w, h) + image.tobytes()
    return b"P7\nWIDTH %d\nHEIGHT %d\nDEPTH %d\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n" % (w, h, c) + image.tobytes()


def to_byte(x: np.ndarray) -> np.ndarray:
    """Values of 0 to 1 as bytes: clipped, then truncated."""
    return np.clip(x * 255, 0, 255).astype(np.uint8)


def tone_mapper() -> Callable[[np.ndarray], np.ndarray]:
    """OpenCV's contrast-domain operator if it is there, else :func:`tone_map`."""
    try:
        import cv2
    except ImportError:
        return tone_map
    operator = cv2.createTonemapMantiuk(scale=SCALE, saturation=SATURATION)
    return lambda image: to_byte(np.nan_to_num(operator.process(image[..., :3].astype(np.float32) / 255)))


def segmenter(model: str = "u2net") -> Callable[[np.ndarray], np.ndarray]:
    """rembg's background removal with one session a worker if it is there, else :func:`remove_background`."""
    try:
        import rembg
    except ImportError:
        return remove_background
    session = rembg.new_session(model)
    return lambda image: np.asarray(rembg.remove(np.ascontiguousarray(image), session=session))


def tone_map(image: np.ndarray, scale: float = SCALE, saturation: float = SATURATION) -> np.ndarray:
    """Contrast-domain tone mapping: log-luminance differences to the local mean shrink by level of
    a pyramid, colours keep ``saturation`` of their ratio to luminance; clipped, then truncated."""
    x = image[..., :3].astype(np.float32) / 255
    light = np.maximum(x.mean(axis=2), 1e-4)
    log = np.log(light)
    base, out, size = log, np.zeros_like(log), 1
    while size < max(2, min(log.shape) // 2):
        blurred = _box(base, size)
        detail = base - blurred
        out += np.sign(detail) * np.abs(detail) ** (1 + (1 - scale) * 0.5) * scale
        base, size = blurred, size * 2
    out = np.exp(out + base * scale)
    mapped = (x / light[..., None]) ** saturation * out[..., None]
    top = mapped.max()
    mapped = mapped / top if top > 0 else mapped
    return to_byte(mapped)


def _box(m: np.ndarray, r: int) -> np.ndarray:
    """Mean over the square of radius ``r``, edges repeated."""
    for axis in (0, 1):
        pad = [(r + 1, r) if a == axis else (0, 0) for a in (0, 1)]
        c = np.cumsum(np.pad(m, pad, mode="edge"), axis=axis, dtype=np.float64)
        hi, lo = [slice(None)] * 2, [slice(None)] * 2
        hi[axis], lo[axis] = slice(2 * r + 1, None), slice(None, -2 * r - 1)
        m = (c[tuple(hi)] - c[tuple(lo)]) / (2 * r + 1)
    return m.astype(np.float32)


def remove_background(image: np.ndarray, tolerance: float = 40.0) -> np.ndarray:
    """An alpha channel that hides pixels close to the border's median colour."""
    x = image[..., :3].astype(np.float32)
    edge = np.concatenate([x[0], x[-1], x[:, 0], x[:, -1]])
    far = np.sqrt(((x - np.median(edge, axis=0)) ** 2).sum(axis=2)) > tolerance
    return np.dstack([image[..., :3], (far * 255).astype(np.uint8)])


def local_descriptors(image: np.ndarray, stride: int = 8, crop: int = CROP) -> np.ndarray:
    """Gradient histograms of 16 x 16 patches, 4 x 4 cells of 8 directions: n x 128, n may be 0.

    Taken from the centre crop; patches that the alpha channel hides, or that are flat, have none.
    """
    h, w = image.shape[:2]
    top, left = max(0, (h - crop) // 2), max(0, (w - crop) // 2)
    image = image[top : top + crop, left : left + crop]
    gray = image[..., :3].astype(np.float32).mean(axis=2)
    seen = image[..., 3] > 0 if image.shape[2] == 4 else np.ones(gray.shape, bool)
    if min(gray.shape) < 16:
        return np.empty((0, WIDTH), np.float32)
    dy, dx = np.gradient(gray)
    size, turn = np.hypot(dx, dy), ((np.arctan2(dy, dx) + np.pi) / (2 * np.pi) * 8).astype(int) % 8
    ys, xs = np.arange(0, gray.shape[0] - 15, stride), np.arange(0, gray.shape[1] - 15, stride)
    # Running sums of each direction's gradients; a cell's histogram is that of its four corners.
    planes = np.where(turn[..., None] == np.arange(8), size[..., None], 0.0)
    total = np.zeros((gray.shape[0] + 1, gray.shape[1] + 1, 8))
    total[1:, 1:] = planes.cumsum(axis=0).cumsum(axis=1)
    corners = total[(ys[:, None] + 4 * np.arange(5))[:, None, :, None], (xs[:, None] + 4 * np.arange(5))[None, :, None, :]]
    cells = corners[:, :, 1:, 1:] - corners[:, :, :-1, 1:] - corners[:, :, 1:, :-1] + corners[:, :, :-1, :-1]
    hist = np.maximum(cells, 0.0).reshape(-1, WIDTH)
    covered = np.zeros((gray.shape[0] + 1, gray.shape[1] + 1))
    covered[1:, 1:] = seen.cumsum(axis=0).cumsum(axis=1)
    at = lambda dy, dx: covered[(ys + dy)[:, None], (xs + dx)[None, :]]
    shown = ((at(16, 16) - at(0, 16) - at(16, 0) + at(0, 0)) > 128).ravel()
    norm = np.linalg.norm(hist, axis=1)
    kept = shown & (norm > 1e-3)
    return np.minimum(hist[kept] / norm[kept, None], 0.2).astype(np.float32)


def preprocess(
    images: DataFrame, use_tone_mapping: bool = True, background: Callable[[], Callable] | None = segmenter, reader: Callable = decode, content: str = "content",
    tone: Callable[[], Callable] = tone_mapper, dataset_col: str | None = None, keep_background: tuple[str, ...] = (),
) -> DataFrame:
    """``images`` with ``content`` replaced by the processed image, and ``error`` (null if none).

    ``background`` makes the segmenter, once per worker; None keeps backgrounds. Images whose
    ``dataset_col`` is one of ``keep_background`` keep theirs. An image that cannot be read keeps its
    row, with null content and the reason.
    """
    at = images.columns.index(content)
    of = images.columns.index(dataset_col) if dataset_col else None

    def run(batches):
        cut = background() if background else None
        mapped = tone() if use_tone_mapping else None
        for batch in batches:
            made, errors = [], []
            names = batch.column(of).to_pylist() if of is not None else [None] * batch.num_rows
            for raw, name in zip(batch.column(at).to_pylist(), names):
                try:
                    image = reader(raw)
                    image = mapped(image) if mapped else image
                    made.append(encode(cut(image) if cut and name not in keep_background else image))
                    errors.append(None)
                except (ValueError, TypeError, KeyError, IndexError) as e:
                    made.append(None)
                    errors.append(str(e)[:200] or type(e).__name__)
            yield batch.set_column(at, content, pa.array(made, pa.binary())).append_column("error", pa.array(errors, pa.string()))

    return images.mapInArrow(run, widened(images, "error", "string"))


def extract(images: DataFrame, extractor: Callable[[], Callable[[np.ndarray], np.ndarray]] = lambda: local_descriptors, reader: Callable = decode, id_col: str = "image_id", content: str = "content") -> DataFrame:
    """``image_id, desc_idx, desc``: each image's local descriptors, one row each.

    Images without content or without descriptors have no row.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        find = extractor()
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = find(reader(raw))
                if len(got):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(got), pa.string()), pa.array(np.arange(len(got), dtype=np.int32)), pa.array(list(got.astype(np.float32)), pa.list_(pa.float32()))],
                        names=["image_id", "desc_idx", "desc"],
                    )

    rows = images.select(F.col(id_col).cast("string").alias("image_id"), F.col(content).alias("content")).where("content is not null")
    return rows.mapInArrow(run, "image_id string, desc_idx int, desc array<float>")
