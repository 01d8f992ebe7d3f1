"""Reading tables and running SQL over them."""
