"""Where the given tables lie, for all tests."""

SMALL, FIXTURE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
