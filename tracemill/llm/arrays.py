"""Numpy arrays in the shared folder: written by tasks, memory-mapped by workers.

Where the folder is mounted, arrays are mapped. From a store that cannot be mapped they are read into memory, the ones used last up to
``HELD_BYTES`` a worker; nothing is copied to a machine's own disk.
"""

from __future__ import annotations

import io
import os
import uuid
from collections import OrderedDict
from urllib.parse import urlparse

import numpy as np

#: Bytes of arrays that a worker keeps of a store that cannot be mapped.
HELD_BYTES = 256 << 20
_open: OrderedDict = OrderedDict()


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def put(folder: str, name: str, array: np.ndarray) -> None:
    """Write an array whole under its final name, so that a retried or doubled task does no harm."""
    path = _local(folder)
    if path is None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        temp = f"{base}/{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(temp) as f:
            np.lib.format.write_array(f, array)
        store.move(temp, f"{base}/{name}.npy")
        return
    os.makedirs(path, exist_ok=True)
    temp = f"{path}/.{name}.{uuid.uuid4().hex}"
    with open(temp, "wb") as f:
        np.lib.format.write_array(f, array)
    os.replace(temp, f"{path}/{name}.npy")


def get(folder: str, name: str) -> np.ndarray:
    """The array, kept open by this worker: memory-mapped, or of a store that cannot be mapped read whole."""
    key = (folder, name)
    if key in _open:
        _open.move_to_end(key)
        return _open[key]
    path = _local(folder)
    if path is None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        with store.open_input_stream(f"{base}/{name}.npy") as src:
            found = np.load(io.BytesIO(src.read()))
        held = sum(a.nbytes for a in _open.values()) + found.nbytes
        while _open and held > HELD_BYTES:
            held -= _open.popitem(last=False)[1].nbytes
    else:
        size = os.path.getsize(f"{path}/{name}.npy")
        found = np.load(f"{path}/{name}.npy", mmap_mode="r") if size > 256 else np.load(f"{path}/{name}.npy")
    _open[key] = found
    return found


def close_others(folder: str) -> None:
    """Forget the maps of other models; a worker serves one model at a time."""
    for key in [k for k in _open if k[0] != folder]:
        del _open[key]
