"""Writers of wikis and documents."""
