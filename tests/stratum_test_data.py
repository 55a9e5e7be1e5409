"""Values that several tests share (a module of its own: there is more than one conftest)."""

SF_SMALL = "/root/testdata/sf0.001"
