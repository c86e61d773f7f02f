"""Reading stop and census files, writing result tables."""
