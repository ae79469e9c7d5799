from pkg.core import Base


class Child(Base):
    def go(self):
        self.ping()
        self.missing()
        b = Base()
        b = other()
        b.pong()
        return b


async def run(é: str = "ü"):
    """Döc."""
    await unique_name()


def unique_name():
    pass
