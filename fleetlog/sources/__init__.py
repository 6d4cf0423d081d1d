"""Where rows come from: logs, listings, catalogs and the test tables."""
