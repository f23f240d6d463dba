"""MD5 with a state that one task can hand to the next, which hashlib's objects cannot."""

from __future__ import annotations

import ctypes
import hashlib
import math
import struct
from collections.abc import Callable

BLOCK = 64
START = struct.pack("<4I", 0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)

# From (state, whole blocks) to the state after them.
Blocks = Callable[[bytes, bytes], bytes]


def plain_blocks(state: bytes, data: bytes) -> bytes:
    """The steps of RFC 1321, about 1 MB a second."""
    turns = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
    steps = [(int(abs(math.sin(i + 1)) * 2 ** 32), turns[i // 16][i % 4], (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16) for i in range(64)]
    words = struct.unpack("<4I", state)
    for at in range(0, len(data), BLOCK):
        x = struct.unpack_from("<16I", data, at)
        a, b, c, d = words
        for i, (add, turn, word) in enumerate(steps):
            if i < 16:
                f = (b & c) | (~b & d)
            elif i < 32:
                f = (d & b) | (~d & c)
            elif i < 48:
                f = b ^ c ^ d
            else:
                f = c ^ (b | (~d & 0xFFFFFFFF))
            f = (a + f + add + x[word]) & 0xFFFFFFFF
            a, d, c, b = d, c, b, (b + (f << turn | f >> (32 - turn))) & 0xFFFFFFFF
        words = tuple((u + v) & 0xFFFFFFFF for u, v in zip(words, (a, b, c, d)))
    return struct.pack("<4I", *words)


def openssl_blocks() -> Blocks:
    """The same by MD5_Update of the OpenSSL library that hashlib loads. Its public MD5_CTX (92 bytes) begins with the four words of the state."""
    import _hashlib
    update = ctypes.CDLL(_hashlib.__file__).MD5_Update
    update.argtypes, update.restype = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t], ctypes.c_int

    def blocks(state: bytes, data: bytes) -> bytes:
        context = ctypes.create_string_buffer(struct.pack("=4I", *struct.unpack("<4I", state)), 256)
        update(context, data, len(data))
        return struct.pack("<4I", *struct.unpack_from("=4I", context))
    return blocks


def finish(blocks: Blocks, state: bytes, tail: bytes, size: int) -> str:
    """The digest in hexadecimal of `size` bytes, the state being that before the tail."""
    padding = b"\x80" + bytes(-(len(tail) + 9) % BLOCK) + struct.pack("<Q", size * 8 % 2 ** 64)
    return blocks(state, tail + padding).hex()


def block_function() -> Blocks:
    """OpenSSL's blocks where they are to be had and agree with hashlib, else the plain ones."""
    probe = bytes(range(200))
    try:
        blocks = openssl_blocks()
        if finish(blocks, blocks(START, probe[:128]), probe[128:], len(probe)) == hashlib.md5(probe, usedforsecurity=False).hexdigest():
            return blocks
    except (ImportError, OSError, AttributeError):
        pass
    return plain_blocks
