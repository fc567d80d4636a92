"""Fixed values shared by the whole package (names, units, letters, formats)."""

# --- fixed values: object types of an inventory row ---
FILE = "FS_FILE_TYPE_FILE"
DIRECTORY = "FS_FILE_TYPE_DIRECTORY"
SYMLINK = "FS_FILE_TYPE_SYMLINK"

# --- fixed values: words accepted for an object type ---
TYPE_WORDS = {
    "file": FILE, "f": FILE,
    "directory": DIRECTORY, "dir": DIRECTORY, "d": DIRECTORY,
    "symlink": SYMLINK, "link": SYMLINK, "l": SYMLINK,
}

# --- fixed values: extended attributes, and the ones that can be set ---
ATTRIBUTES = (
    "read_only", "hidden", "system", "archive", "temporary", "compressed",
    "not_content_indexed", "sparse_file", "offline",
)
SETTABLE = ("read_only", "hidden", "system", "archive")
ATTRIBUTE_WORDS = {
    "sparse": "sparse_file",
    "readonly": "read_only",
    "nci": "not_content_indexed",
    "not_indexed": "not_content_indexed",
}

# --- fixed values: column order of a full export ---
EXPORT_COLUMNS = (
    "path", "name", "type", "id", "file_number",
    "size", "blocks", "datablocks", "metablocks",
    "owner", "owner_details", "group", "group_details",
    "creation_time", "modification_time", "access_time", "change_time",
    "mode", "num_links", "child_count", "symlink_target_type",
    "major_minor_numbers", "extended_attributes",
    "directory_entry_hash_policy", "data_revision", "user_metadata_revision",
)
TIME_FIELDS = ("creation_time", "modification_time", "access_time", "change_time")

# --- fixed values: short names for nested or computed fields ---
FIELD_WORDS = {
    "owner_id": "owner_details.id_value",
    "owner_type": "owner_details.id_type",
    "group_id": "group_details.id_value",
    "group_type": "group_details.id_type",
    "capacity": "total_capacity",
}
DETAIL_FIELDS = ("path", "size", "change_time")
DIRECTORY_DETAIL_FIELDS = ("path", "capacity", "change_time")

# --- fixed values: size units as typed by a user ---
BLOCK = 4096
DECIMAL_POWERS = {"kb": 1, "mb": 2, "gb": 3, "tb": 4, "pb": 5}
BINARY_POWERS = {"kib": 1, "mib": 2, "gib": 3, "tib": 4, "pib": 5}
UNIT_BYTES = {
    "": 1, "b": 1,
    **{u: 1000 ** p for u, p in DECIMAL_POWERS.items()},
    **{u: 1024 ** p for u, p in BINARY_POWERS.items()},
}
# --- fixed values: size units as shown ---
BINARY_LABELS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")
DECIMAL_LABELS = ("B", "KB", "MB", "GB", "TB", "PB", "EB")

# --- fixed values: characters that make an unanchored pattern look like a regex ---
REGEX_CHARACTERS = frozenset("^$.+()|{}\\")

# --- fixed values: access-control letters, presets, flags ---
RIGHTS = "rwaxdDtTnNcCoy"
RIGHT_PRESETS = {
    "read": "rtncy",
    "write": "waTN",
    "modify": "rwaxdtTnNcy",
    "fullcontrol": RIGHTS,
}
ALLOW = "Allow"
DENY = "Deny"
INHERITED = "INHERITED"
PROTECTED = "PROTECTED"
OWNER_AT, GROUP_AT, EVERYONE_AT = "OWNER@", "GROUP@", "EVERYONE@"
MODE_RIGHTS = {4: "r", 2: "wa", 1: "x"}

# --- fixed values: identity domains, best first when a name is borrowed ---
DOMAIN_RANK = {"ACTIVE_DIRECTORY": 0, "LOCAL": 1, "POSIX_USER": 2, "POSIX_GROUP": 2}

# --- fixed values: snapshots made by replication ---
REPLICATION_PREFIXES = ("replication_from_", "replication_to_")

# --- own choices: similarity sampling and byte comparison ---
SAMPLE_BYTES = 64 * 1024
SAMPLE_STEPS = ((1 << 20, 3), (100 << 20, 5), (1 << 30, 7))
SAMPLE_MOST = 11
CHUNK = 4096
WHOLE_FILE_BELOW = 1 << 20
