"""Batch operators that write chunks or tag them."""
