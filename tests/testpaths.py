"""Where the example tables are."""

SMALL = "/root/testdata/sf0.001"
