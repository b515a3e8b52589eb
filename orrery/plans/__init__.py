"""Session, materialisation and registered query plans."""
