"""Where data come from and go to: files, sorted runs, the manifest, table mappings."""
