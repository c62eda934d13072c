"""Files in a store that the driver and all executors reach, opened by their URI."""

from __future__ import annotations


def opened(uri: str, mode: str = "r"):  # noqa: ANN201
    """A random-access file to read, or a new file to write whose folders are made."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if mode == "r":
        return store.open_input_file(path)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(path, compression=None)
