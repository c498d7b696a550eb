"""On-disk layout as data: offsets in bytes, little-endian unsigned unless said otherwise."""

from __future__ import annotations

import numpy as np

SUPERBLOCK_AT = 1 << 16
SUPERBLOCK_BYTES = 1 << 12
#: Later copies of the superblock; known, not read.
SUPERBLOCK_COPIES = (1 << 26, 1 << 38)
MAGIC_AT, MAGIC = 64, b"_BHRfS_M"
FSID_AT, FSID_BYTES = 32, 16

#: Superblock field -> (offset, bytes).
SUPERBLOCK = {
    "root_level": (198, 1),
    "nodesize": (148, 4),
    "sectorsize": (144, 4),
    "root_dir_objid": (128, 8),
    "bytes_used": (120, 8),
    "total_bytes": (112, 8),
    "chunk_tree_addr": (88, 8),
    "root_tree_addr": (80, 8),
    "generation": (72, 8),
}
ARRAY_SIZE_AT, ARRAY_AT = 160, 811

HEADER_BYTES = 101
#: Node header field -> (offset, bytes).
HEADER = {"logical_bytenr": (48, 8), "gen": (80, 8), "owner": (88, 8), "nritems": (96, 4), "level": (100, 1)}
CHECKED_FROM = 32

KEY = [("objectid", "<u8"), ("type", "u1"), ("key_offset", "<u8")]
ITEM = np.dtype([*KEY, ("data_offset", "<u4"), ("data_size", "<u4")])
POINTER = np.dtype([*KEY, ("child", "<u8"), ("child_gen", "<u8")])
CHUNK_BYTES, STRIPE_BYTES = 48, 32

INODE, REF, DIR_ITEM, DIR_INDEX, EXTENT = 1, 12, 84, 96, 108
ROOT, EXTENT_ENTRY, EXTENT_REF, DEVICE, CHUNK = 132, 168, 178, 216, 228
#: Types that make a slot past the last valid one plausible, and those that internal slack is mined for.
PLAUSIBLE = (INODE, REF, DIR_ITEM, DIR_INDEX, EXTENT)
MINED = (*PLAUSIBLE, ROOT)
ORPHAN_SLOTS = 200

EXTENT_TREE, DEVICE_TREE, FIRST_SUBVOLUME = 2, 4, 256

INODE_BYTES = 160
#: Inode field -> (offset, bytes).
INODE_FIELDS = {
    "sequence": (72, 8), "flags": (64, 8), "rdev": (56, 8), "mode": (52, 4), "gid": (48, 4), "uid": (44, 4),
    "nlink": (40, 4), "block_group": (32, 8), "nbytes": (24, 8), "size": (16, 8), "transid": (8, 8), "generation": (0, 8),
}
#: Where the times are, by choice of layout: (signed seconds, 8 bytes; nanoseconds, 4 bytes).
INODE_TIMES = {
    "parity": {"atime": 80, "ctime": 92, "mtime": 104, "otime": 116},
    "spec": {"atime": 112, "ctime": 124, "mtime": 136, "otime": 148},
}

DIR_HEADER, EXTENT_HEADER, EXTENT_POINTER = 30, 21, 32
LONGEST_NAME = 255
#: A payload is handed on with at least this much of its node, as some decoders read past an item's stated size.
WINDOW = DIR_HEADER + LONGEST_NAME
ROOT_BYTES, ROOT_RESERVED = 439, (235, 439)
DEVICE_BYTES, DEVICE_UUID = 98, {"parity": 82, "spec": 66}
EXTENT_REF_BYTES = 28

TYPE_NAMES = {
    228: "CHUNK_ITEM", 216: "DEV_ITEM", 192: "BLOCK_GROUP_ITEM", 168: "EXTENT_ITEM", 156: "ROOT_REF", 132: "ROOT_ITEM",
    108: "EXTENT_DATA", 96: "DIR_INDEX", 84: "DIR_ITEM", 48: "ORPHAN_ITEM", 24: "XATTR_ITEM", 13: "INODE_EXTREF", 12: "INODE_REF", 1: "INODE_ITEM",
}
FILE_TYPE_NAMES = dict(enumerate("unknown file dir chrdev blkdev fifo sock symlink xattr".split()))
COMPRESSION_NAMES = dict(enumerate(("zlib", "lzo", "zstd"), 1))
