"""The hierarchical array file format: bytes to objects and back, and Spark data sources over it."""

from .reader import File, is_h5, is_h5_bytes
from .space import AddressRange, FileSpaceInfo, FillTime, FreeSection, MessageType, PhysicalAddress, StatusFlags, StoredAddress, Superblock, clear_status_flags, file_space_info, persisted_free_sections
from .types import BitField, Compound, Enum, Fixed, Float, Opaque, Reference, String, Time, VarString, Vlen, of_element
from .writer import FileBuilder

__all__ = [
    "AddressRange", "BitField", "Compound", "Enum", "File", "FileBuilder", "FileSpaceInfo", "FillTime", "Fixed", "Float", "FreeSection", "MessageType", "Opaque", "PhysicalAddress",
    "Reference", "StatusFlags", "StoredAddress", "String", "Superblock", "Time", "VarString", "Vlen", "clear_status_flags", "file_space_info", "is_h5", "is_h5_bytes", "of_element", "persisted_free_sections",
]
