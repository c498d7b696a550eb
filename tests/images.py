"""A writer of synthetic images for the tests, written with ``struct`` and its own slow checksum."""

import struct

SIZE = 16384
FSID = bytes(range(16))


def slow_crc32c(data: bytes) -> int:
    table = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (0x82F63B78 if i & 1 else 0)
        table.append(i)
    crc = 0xFFFFFFFF
    for b in data:
        crc = table[(crc ^ b) & 0xFF] ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


def leaf(gen, owner, items, n=None, extra=(), size=SIZE, bad=False, bytenr=0):
    """items: (objectid, type, key_offset, payload); ``n``: the stated number; extra: (offset, bytes) put over the rest."""
    node = bytearray(size)
    node[32:48] = FSID
    struct.pack_into("<Q", node, 48, bytenr)
    struct.pack_into("<QQIB", node, 80, gen, owner, len(items) if n is None else n, 0)
    end = size - 101
    for k, (objectid, kind, offset, payload) in enumerate(items):
        end -= len(payload)
        struct.pack_into("<QBQII", node, 101 + 25 * k, objectid, kind, offset, end, len(payload))
        node[101 + end : 101 + end + len(payload)] = payload
    for at, data in extra:
        node[at : at + len(data)] = data
    return seal(node, bad)


def inner(gen, owner, children, n=None, level=1, extra=(), size=SIZE):
    node = bytearray(size)
    node[32:48] = FSID
    struct.pack_into("<QQIB", node, 80, gen, owner, len(children) if n is None else n, level)
    for k, child in enumerate(children):
        struct.pack_into("<QBQQQ", node, 101 + 33 * k, 0, 0, 0, child, gen)
    for at, data in extra:
        node[at : at + len(data)] = data
    return seal(node)


def seal(node, bad=False):
    struct.pack_into("<I", node, 0, slow_crc32c(bytes(node[32:])) ^ (1 if bad else 0))
    return bytes(node)


def dirent(inode, name, kind=1):
    name = name if isinstance(name, bytes) else name.encode()
    return struct.pack("<QBQQHHB", inode, 1, 0, 0, 0, len(name), kind) + name


def refs(*names):
    return b"".join(struct.pack("<QH", i, len(n.encode())) + n.encode() for i, n in enumerate(names))


def inline(data, compression=0):
    return struct.pack("<QQBBHB", 0, len(data), compression, 0, 0, 0) + data


def regular(disk, disk_n, offset, n, kind=1):
    return struct.pack("<QQBBHB", 0, n, 0, 0, 0, kind) + struct.pack("<QQQQ", disk, disk_n, offset, n)


def inode(size=1024, sec=1700000000, **more):
    f = dict(generation=10, transid=10, nbytes=size, group=0, nlink=1, uid=1000, gid=1000, mode=0o100644, rdev=0, flags=0, sequence=1) | more
    body = struct.pack("<QQQQQIIIIQQQ", f["generation"], f["transid"], size, f["nbytes"], f["group"], f["nlink"], f["uid"], f["gid"], f["mode"], f["rdev"], f["flags"], f["sequence"])
    return body + struct.pack("<qI", sec, 123456789) * 4 + bytes(32)


def chunk(length, *stripes):
    return struct.pack("<Q", length) + bytes(36) + struct.pack("<H", len(stripes)) + bytes(2) + b"".join(struct.pack("<QQ", 1, s) + bytes(16) for s in stripes)


def superblock(generation=100, total=1000, used=600, nodesize=SIZE, chunk_root=0x1000000, array=((0x1000000, 65536, 0x14000),)):
    sb = bytearray(4096)
    sb[32:48] = FSID
    sb[64:72] = b"_BHRfS_M"
    struct.pack_into("<QQQ", sb, 0x48, generation, 0x1234000, chunk_root)
    struct.pack_into("<QQQ", sb, 0x70, total, used, 6)
    struct.pack_into("<II", sb, 0x90, 4096, nodesize)
    data = b"".join(struct.pack("<QBQ", 256, 228, start) + chunk(length, physical) for start, length, physical in array)
    struct.pack_into("<I", sb, 0xA0, len(data))
    sb[0x32B : 0x32B + len(data)] = data
    return bytes(sb)


def sample_image() -> bytes:
    """Thirteen nodes that touch every branch; what they hold is in FIXTURES.md, section 3."""
    big = struct.pack("<QBQ", 0, 0, 0)
    assert len(big) == 17
    nodes = [
        inner(100, 3, [0x1004000]),
        leaf(100, 3, [(256, 228, 0x1000000, chunk(65536, 0x14000)), (256, 228, 0x5000000, chunk(65536, 0x20000))]),
        leaf(
            50, 5,
            [
                (257, 1, 0, inode()), (257, 12, 256, refs("longer_name.txt", "b")), (256, 84, 1, dirent(257, "a.txt")), (256, 96, 2, dirent(257, "a.txt")),
                (257, 108, 0, inline(b"inline file data!")), (258, 108, 0, inline(b"zipped", 1)),
            ],
            extra=[(400, b"SLACK")],
        ),
        leaf(
            60, 5,
            [
                (256, 84, 1, dirent(257, "renamed.txt")), (257, 108, 0, regular(0x5000000, 8192, 0, 4096)), (257, 108, 1, regular(0x5000000, 8192, 0, 4096)),
                (257, 108, 2, regular(0x9999000, 4096, 0, 4096)), (257, 108, 3, regular(0x9999000, 4096, 0, 4096)), (257, 108, 4, regular(0, 0, 0, 4096)),
                (257, 108, 5, regular(0x5000000, 4096, 0, 4096, kind=2)), (257, 108, 6, regular(0x5000000, 8192, 4096, 4096)),
                (256, 84, 7, dirent(300, b"bad\xff\xfename")), (256, 84, 8, dirent(301, "x\x01y")), (256, 84, 9, dirent(302, "nb sp")),
            ],
        ),
        leaf(70, 5, [(1, 1, 0, inode()), (256, 84, 1, dirent(400, "orph.txt")), (400, 108, 0, inline(b"orphan in"))], n=1),
        leaf(100, 5, [(1, 1, 0, inode()), (256, 84, 1, dirent(401, "cur.txt")), (401, 108, 0, inline(b"current!"))], n=1),
        leaf(105, 256, [(259, 1, 0, inode())]),
        leaf(40, 5, [(260, 1, 0, inode())], bad=True),
        leaf(55, 2, [(0x111000, 168, 4096, bytes(24)), (0x111000, 178, 0, struct.pack("<QQQI", 5, 257, 0, 1))]),
        leaf(55, 4, [(1, 216, 1, struct.pack("<QQQ", 1, 1000, 600) + bytes(42) + b"U" * 16 + b"F" * 16)]),
        inner(56, 5, [0x1004000, 0x2000000, 0x3000000, 0, 0x4000000], n=1),
        leaf(57, 1, [(5, 132, 0, bytes(239) + b"\x01" + bytes(199))]),
        leaf(58, 5, []),
    ]
    head = bytearray(0x14000)
    head[:4] = b"BOOT"
    head[0x10000:0x11000] = superblock()
    return bytes(head) + b"".join(nodes) + b"tail"
