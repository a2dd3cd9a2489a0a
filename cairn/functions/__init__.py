"""Part of the cairn package; see README.md."""
