�� bad