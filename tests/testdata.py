"""Folders of the given tables, under a name that no other test folder has."""

SF001 = "/root/testdata/sf0.01"
